"""Each operator against a plain version, on real rows and on awkward ones."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from gridloom.llm import fingerprint, packing, words
from gridloom.llm.decontaminate import contamination
from gridloom.llm.fingerprint_chain import edited_text, fingerprint_chain, fingerprints
from gridloom.llm.jaccard_join import boundary, jaccard_components, needed, partners
from gridloom.llm.language_id import fit_languages, identify_languages, mixture
from gridloom.llm.license_scan import scan_licenses
from gridloom.llm.line_dedup import dedup_lines
from gridloom.llm.substring_dedup import dedup_substrings
from gridloom.llm.suffix_array import common_prefixes, suffix_array
from gridloom.llm.toxicity import Model, fit_toxicity, score_toxicity
from gridloom.llm.url_filter import filter_urls

from . import brute

CLASHES = ("id", "th", "n", "h", "key", "token", "label", "score", "rest", "body", "a", "b", "word", "raw", "r", "lines_total", "toxicity", "rank", "piece")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def awkward_texts():
    rng = random.Random(7)
    base = " ".join(rng.choices(WORDS, k=120))
    near = base.split()
    near[60] = "changed"
    long = " ".join(rng.choices(WORDS, k=9000))
    lines = "first line here\nsecond line here\nthird line here\nfourth"
    return [
        (1, base), (2, " ".join(near)), (3, base), (3, base), (4, None), (5, ""), (6, "   \n\t "), (7, long), (8, long[:30000] + " tail"), (9, lines), (10, "x\n" + lines + "\n\n" + lines), (11, "Straße ÉCOLE Kİ 日本語 a"),
        (12, "one"), (13, "one"), (14, "ONE two"), (None, base), (None, None), (15, "=" * 300), (16, "=" * 200), (17, "CC BY all rights reserved. GNU General Public License; all-rights\nreserved"), (18, "é <|endoftext|> it's 12,5"),
    ]


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    real = [(r["doc_id"] + 1000, r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(120).collect()]
    return awkward_texts() + real


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for c in CLASHES:
        df = df.selectExpr("*", f"'extra' as `{c}`")
    return df.cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_words_match_the_patterns(rows):
    import pyarrow as pa

    texts = [(t or "") + "\n" for _, t in rows]
    column = pa.array(texts)
    for kind, plain in ((words.ALNUM, brute.alnum_words), (words.SOLID, brute.solid_words)):
        got = []
        for part in words.slices(column, 5000):
            w = words.words(part, kind)
            for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True):
                got.append([w.low[x:y].tobytes().decode() for x, y in zip(w.starts[a:b], w.ends[a:b], strict=True)])
        assert got == [plain(t) for t in texts]


def test_packing_ids_and_places(docs, rows, none):
    from tokenizers import Tokenizer

    got = packing.pack(packing.token_pieces(docs, with_ids=True)).collect()
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(i, p // 4096, p, len(ids[p : p + 4096]), zlib.crc32(np.array(ids[p : p + 4096], "<u4").tobytes()), ids[p : p + 4096]) for p in range(0, len(ids), 4096)]
    order = lambda x: (x[0] is None, x[0] or 0, x[1], x[3])
    assert sorted(((r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"], r["ids"]) for r in got), key=order) == sorted(want, key=order)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 4096
    assert packing.pack(packing.token_pieces(none)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan_is_whole_and_tight(seed):
    rng = random.Random(seed)
    histogram = {}
    for _ in range(rng.choice([1, 30, 3000])):
        s = rng.choice([rng.randint(1, 4096), rng.randint(1, 300), 1366, 2048, 4096])
        histogram[s] = histogram.get(s, 0) + 1
    runs, bins = packing.plan_bins(histogram)
    fill, places, large = [[] for _ in range(bins)], {}, [0] * bins
    for s, lo, hi, first, offset in runs.tolist():
        for k in range(lo, hi):
            places.setdefault(s, []).append(k)
            fill[first + k - lo].append((offset, s))
            large[first + k - lo] += 3 * s > 4096
    assert {s: sorted(p) == list(range(histogram[s])) for s, p in places.items()} == dict.fromkeys(histogram, True)
    for f in fill:
        f.sort()
        assert [o for o, _ in f] == [sum(s for _, s in f[:k]) for k in range(len(f))] and 0 < sum(s for _, s in f) <= 4096
    assert max(large, default=0) <= 2
    total, halves = sum(s * n for s, n in histogram.items()), sum(n for s, n in histogram.items() if s > 2048)
    assert bins <= max(math.ceil(total / 4096), halves) * 1.25 + 1


def test_decontamination(spark, docs, rows, none):
    long = rows[7][1]
    items = [(1, " ".join(brute.alnum_words(long)[50:80])), (2, "Rights, RESERVED"), (3, ""), (4, None), (None, "one"), (5, "second line here third line"), (5, "second line here third line"), (6, "unseen words only here and there so be it now or never")]
    table = spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, h string, win string")
    got = contamination(docs, table).collect()
    want = [(i, *brute.contaminated(t, items)) for i, t in rows]
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], sorted(r["items"])) for r in got), key=order) == sorted(((i, n, h, sorted(map(str, f))) for i, n, h, f in want), key=order)
    assert any(r["n_hit"] for r in got)
    assert contamination(none, table).count() == 0
    assert contamination(docs, table.limit(0)).where("n_hit > 0").count() == 0


def test_line_dedup(docs, rows, none):
    got = dedup_lines(docs)
    assert got.columns == [*docs.columns, "lines_total_", "lines_removed"]
    single = sorted({r for r in rows if r[0] is not None}, key=lambda r: r[0])
    # null ids come first in the order of documents
    want = brute.line_windows_removed([(None, t) for i, t in rows if i is None] + single)
    for r in got.collect():
        if r["doc_id"] is not None:
            assert r["text"] == want[r["doc_id"]] and r["id"] == "extra"
    assert got.count() == len(rows) and got.agg({"lines_removed": "max"}).first()[0] > 0
    assert dedup_lines(none).count() == 0


def test_jaccard_components(docs, rows, none):
    want = brute.components([r for r in rows if r[0] is not None])
    got = jaccard_components(docs).collect()
    assert len(got) == len(rows)
    sizes = {i: len(brute.shingles(t, 4)) for i, t in rows}
    for r in got:
        if r["doc_id"] is not None:
            assert (r["component_id"], r["n_shingles"]) == (want[r["doc_id"]], sizes[r["doc_id"]])
    assert want[2] == want[3] == 1 and {r["component_id"] for r in got if r["doc_id"] is None and r["n_shingles"]} == {1}
    assert jaccard_components(none).count() == 0


def test_jaccard_join_with_many_small_and_chained_sets(spark):
    rng = random.Random(3)
    rows = []
    for g in range(12):
        seed = [f"w{g}x{k}" for k in range(rng.randint(5, 60))]
        for _ in range(rng.randint(2, 9)):
            seed = list(seed)
            for _ in range(rng.randint(0, 2)):
                seed[rng.randrange(len(seed))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(seed)))
    for k in (4, 2):
        got = {r["doc_id"]: r["component_id"] for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k=k).collect()}
        assert got == brute.components(rows, k)


def test_jaccard_bounds():
    for s in range(1, 40):
        for t in range(1, 40):
            o = next((o for o in range(min(s, t) + 1) if 100 * o >= 85 * (s + t - o)), None)
            assert (t in partners(s)) == (o is not None)
            if o is not None:
                assert needed(s, t) == o
    assert boundary({}) == 0 and boundary({5: 10, 6: 10}) >= 6


def test_fingerprints(spark, docs, rows, none):
    got = fingerprint_chain(docs).collect()
    assert len(got) == len(rows)
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0])
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r)
    errors = []
    for k, (i, t) in enumerate(order[:-1]):
        nxt, t = order[k + 1][1] or "", t or ""
        r = by_id[i][0]
        edited = edited_text(t, nxt)
        assert r["n_chars"] == len(t)
        if i != 3:  # the first of two equal rows is followed by the second
            assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            own = brute.shingles(t, 5)
            errors += [abs(r["near_edited"] - brute.jaccard(own, brute.shingles(edited, 5))), abs(r["near_next"] - brute.jaccard(own, brute.shingles(nxt, 5)))]
    assert np.mean(errors) < 0.03 and max(errors) < 0.2
    prints = {}
    for r in fingerprints(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        prints.setdefault(r["text"], set()).add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values()) and prints[""] == {""}
    assert fingerprint_chain(none).count() == 0
    one = fingerprint_chain(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one["near_next"] == 1.0


def chained(rows):
    """Each row's edited text by plain sorting, for rows (id, text) whose text hashes do not matter."""
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0], reverse=True) + [r for r in rows if r[0] is None]
    return {r[0]: hashlib.sha256(edited_text(r[1], order[(k + 1) % len(order)][1]).encode()).hexdigest() for k, r in enumerate(order)}


@pytest.mark.parametrize("kind", ["string", "date", "decimal(20,2)"])
def test_fingerprints_take_ids_of_any_type(spark, kind):
    table = spark.range(300).selectExpr(f"cast({'date_from_unix_date(cast(id as int))' if kind == 'date' else 'id'} as {kind}) as doc_id", "concat_ws(' ', id, id * 7, id * id, 'tail of it') as text")
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    assert {r["doc_id"]: r["edited_sha256"] for r in fingerprint_chain(table).collect()} == chained(rows)


def test_many_rows_of_one_id_are_dealt_over_ranges(spark, monkeypatch):
    from pyspark.sql import functions as F

    from gridloom.llm import fingerprint_chain as chain

    monkeypatch.setattr(chain, "RANGE_ROWS", 100)
    table = spark.range(4000).selectExpr("if(id < 2500, null, if(id < 3500, 77, id)) as doc_id", "concat('text number ', id) as text").repartition(5)
    shown = table.select(F.col("doc_id").alias("number"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), "text")
    sizes = {r["r"]: r["count"] for r in chain._ranges(shown).where("not last").groupBy("r").count().collect()}
    assert len(sizes) > 30 and max(sizes.values()) < 400
    rows = [(r["number"], r["th"], r["text"]) for r in shown.collect()]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = sorted(hashlib.sha256(edited_text(r[2], order[(k + 1) % len(order)][2]).encode()).hexdigest() for k, r in enumerate(order))
    assert sorted(r["edited_sha256"] for r in fingerprint_chain(table).collect()) == want


def test_fingerprint_bias_is_corrected():
    rng = np.random.default_rng(0)
    import pyarrow as pa

    texts = [" ".join(f"{a}" for a in rng.integers(0, 10**9, 600)) + "\n" for _ in range(60)]
    part = next(words.slices(pa.array(texts), 1 << 30))
    values, none = fingerprint.signatures(part)
    likes = fingerprint.likeness(values[:-1], values[1:], none[:-1], none[1:])
    assert abs((values[:-1] == values[1:]).mean() - 1 / 256) < 2e-3 and likes.mean() < 5e-3


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for trial in range(150):
        text = rng.integers(0, rng.integers(1, 6), rng.integers(0, 70)).astype(np.uint8)
        if trial % 4 == 0:
            text = np.tile(text[:3], 20)
        raw = text.tobytes()
        want = sorted(range(len(raw)), key=lambda i: raw[i:])
        assert suffix_array(text).tolist() == want
        if len(raw):
            shared = common_prefixes(text, np.array(want, np.int32), 10)
            for i, j in zip(want[1:], want[:-1], strict=True):
                n = 0
                while n < 10 and max(i, j) + n < len(raw) and raw[i + n] == raw[j + n]:
                    n += 1
                assert shared[i] == n


def test_suffix_array_of_real_text_recurses(spark, sf_dir, monkeypatch):
    from gridloom.llm import suffix_array as module

    sizes = []
    by_names = module._by_names
    monkeypatch.setattr(module, "_by_names", lambda names: (sizes.append(len(names)), by_names(names))[1])
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").limit(40).collect()]
    text = np.frombuffer("".join(texts).encode()[:200_000], np.uint8)
    array = suffix_array(text)
    raw = text.tobytes()
    assert len(sizes) >= 2 and sizes == sorted(sizes, reverse=True) and sorted(array.tolist()) == list(range(len(raw)))
    assert all(raw[a : a + 4000] <= raw[b : b + 4000] for a, b in zip(array[:-1].tolist(), array[1:].tolist(), strict=True))


def test_substring_dedup(docs, rows, none):
    want = brute.without_repeats(rows)
    got = dedup_substrings(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
        else:
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]]
            assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]
    assert dedup_substrings(none).count() == 0


def _same_as_plain(docs, want):
    for r in dedup_substrings(docs, with_bytes=False).collect():
        if r["doc_id"] is not None:
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]]


def test_substring_dedup_with_hot_keys(docs, rows, monkeypatch):
    """Every key that two documents have goes the way of hot ones; the result is the same."""
    from gridloom.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "HOT_DOCS", 2)
    _same_as_plain(docs, brute.without_repeats(rows))
    monkeypatch.setattr(substring_dedup, "CROWD", 1)
    _same_as_plain(docs, brute.without_repeats(rows))


def test_substring_dedup_of_a_phrase_in_all_documents(spark, monkeypatch):
    """One phrase in every text, in different surroundings: its keys are dealt on by longer grams."""
    from gridloom.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "HOT_DOCS", 20)
    monkeypatch.setattr(substring_dedup, "CROWD", 8)
    rng = np.random.default_rng(5)
    around = ["".join(map(chr, rng.integers(97, 123, 60))) for _ in range(40)]
    rows = [(i, around[rng.integers(40)][: rng.integers(20, 60)] + " every single one of them has " + around[rng.integers(40)] + "a" * int(rng.integers(80) * (i % 3 == 0))) for i in range(300)]
    want = brute.without_repeats(rows)
    assert sum(x[1] > 0 for x in want.values()) > 100
    _same_as_plain(spark.createDataFrame(rows, "doc_id long, text string"), want)


def _table_texts(n, lines, rng):
    """Different texts in which one gram recurs every 32 bytes, but for a passage that the first and the last share."""
    texts = ["".join("| value of it now | %014d" % rng.integers(10**13) for _ in range(lines)) for _ in range(n)]
    texts[-1] = texts[0][400:700] + texts[-1]
    return [(i, t) for i, t in enumerate(texts)]


def test_substring_dedup_of_tables_with_one_gram_throughout(spark, monkeypatch):
    """Few documents, but many bytes under one key: it is hot by its segments, and dealt on."""
    from gridloom.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "HOT_SEGMENTS", 64)
    monkeypatch.setattr(substring_dedup, "CROWD", 16)
    monkeypatch.setattr(substring_dedup, "MOST_CROWD", 64)
    rows = [*_table_texts(9, 60, np.random.default_rng(3)), (9, "a" * 3000), (10, "b" + "a" * 2000), (11, None)]
    want = brute.without_repeats(rows)
    assert want[8][1] >= 300 and want[10][1] == 2000
    _same_as_plain(spark.createDataFrame(rows, "doc_id long, text string"), want)


def test_runs_and_suffix_arrays_are_bounded(spark):
    """Twelve texts of 1 MB under one key: no run is endless, the key is hot, and its segments leave the common shards."""
    import pyarrow as pa

    from gridloom.llm import substring_dedup as dedup
    from gridloom.llm import words as W

    rows = _table_texts(12, 32_000, np.random.default_rng(4))
    (part,) = W.slices(pa.array([rows[0][1] + "\n"], pa.large_string()))
    first, last, key = dedup._runs(part, 50, 18)
    assert (last - first).max() < 66 and (np.diff(first) == last[:-1] - first[:-1] + 1).all() and first[0] == 0 and last[-1] == len(rows[0][1]) - 50
    shown = spark.createDataFrame(rows, "id long, text string").select("id", W.text_column("text").alias("text"))
    repeated, hot = dedup._repeated_keys(shown, 50, 18, 8)
    keys, runs = np.unique(key, return_counts=True)
    heavy = keys[runs > dedup.HOT_SEGMENTS]
    assert len(heavy) and dedup._marked(hot, heavy).all() and dedup._marked(repeated, heavy).all()


def test_substring_dedup_takes_text_ids(spark):
    rows = [(x, t) for x, t in zip("dbac", ["q" * 20 + "some passage that is longer than fifty bytes, surely so" + z for z in "wxyz"], strict=True)]
    want = brute.without_repeats(rows)
    _same_as_plain(spark.createDataFrame(rows, "doc_id string, text string"), want)


def test_license_scan(docs, rows, none):
    got = scan_licenses(docs).collect()
    assert len(got) == len(rows)
    phrases = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
    by_id = {r["doc_id"]: r for r in got}
    for i, t in rows:
        if i is None:
            continue
        w, places, labels = brute.alnum_words(t), [], set()
        for label, phrase in phrases:
            p = phrase.split()
            here = [s for s in range(len(w) - len(p) + 1) if w[s : s + len(p)] == p]
            places += here
            labels |= {label} if here else set()
        r = by_id[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert scan_licenses(none).count() == 0


def test_license_templates_bear_small_changes(spark):
    text = "This work is licensed under the GNU and only General Public License, version 3"
    r = scan_licenses(spark.createDataFrame([(1, text), (2, "this work is done")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert "gpl-3.0" in r[0]["labels"].split(",") and r[1]["labels"] == ""


def test_languages(spark, docs, none):
    rng = random.Random(5)
    lexicon = {"en": "the and that with this thing under other".split(), "de": "der und nicht eine schön über werden".split(), "fr": "les des une être où très voilà".split()}
    text = lambda lang, n: " ".join(rng.choices(lexicon[lang], k=n))
    train = spark.createDataFrame([(k, text(lang, 80), lang) for k, lang in enumerate(list(lexicon) * 20)] + [(99, None, "en"), (98, "x y", None)], "doc_id long, text string, lang string")
    langs, table = fit_languages(train)
    assert langs == ["de", "en", "fr"]
    cases = [(1, text("en", 30)), (2, text("de", 30)), (3, text("fr", 200) + " " + text("de", 80)), (4, None), (5, "12 34 %%"), (6, ""), (6, "")]
    got = {r["doc_id"]: r for r in identify_languages(spark.createDataFrame(cases, "doc_id long, text string"), langs, table).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 7)] == ["en", "de", "fr", "und", "und", "und"]
    assert got[3]["languages"] == ["fr", "de"] and abs(got[3]["score"] - 200 / 280) < 0.05 and got[1]["languages"] == ["en"]
    assert identify_languages(docs, langs, table).count() == docs.count()
    empty = fit_languages(train.limit(0))
    assert {r["lang_pred"] for r in identify_languages(docs, *empty).collect()} == {"und"} and identify_languages(none, langs, table).count() == 0


def test_language_sets_of_any_length_and_size():
    rng = np.random.default_rng(1)

    def text(languages, *parts):
        word = np.exp(-rng.gamma(4, 2, (sum(parts), languages))).astype(np.float32)
        word[np.arange(len(word)), np.repeat(np.arange(len(parts)), parts)] = 1
        return word, np.array([len(word)])

    (long,) = mixture(*text(4, 20000, 90))  # a second language is not lost because the text is long
    assert np.flatnonzero(long).tolist() == [0, 1] and abs(long[1] - 90 / 20090) < 0.003
    (many,) = mixture(*text(8, *[300] * 6))
    assert np.flatnonzero(many).tolist() == list(range(6)) and abs(many[:6] - 1 / 6).max() < 0.02
    assert np.flatnonzero(mixture(*text(8, 300))[0]).tolist() == [0]


def test_toxicity(spark, docs, none):
    rng = random.Random(9)
    bad = [f"grumblo{s}" for s in ("x", "yz", "ten", "ig", "um", "ist", "ed", "or")]

    def text(toxic, known):
        ws = rng.choices(WORDS, k=rng.randint(20, 200))
        for _ in range(max(1, len(ws) // 60) if toxic else 0):
            ws[rng.randrange(len(ws))] = rng.choice(bad[: 6 if known else 8])
        return " ".join(ws)

    rows = [(k, text(k % 6 == 0, k < 600), int(k % 6 == 0)) for k in range(900)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    extra = spark.createDataFrame([(None, 1), (5, None), (3, 0), (10**6, 1)], "doc_id long, toxic int")
    scorer = fit_toxicity(table.select("doc_id", "text"), table.where("doc_id < 600").select("doc_id", "toxic").unionByName(extra))
    scored = {r["doc_id"]: r["score"] for r in score_toxicity(table.select("doc_id", "text"), scorer).collect()}
    held = [(scored[k], y) for k, _, y in rows if k >= 600]
    hits = [s >= 0.3 for s, y in held if y]
    false = [s >= 0.3 for s, y in held if not y]
    assert np.mean(hits) > 0.95 and np.mean(false) < 0.03 and all(0 <= s <= 1 for s, _ in held)
    assert score_toxicity(docs, scorer).where("score is null").count() == 0 and score_toxicity(none, scorer).count() == 0
    assert fit_toxicity(table, table.limit(0)) is None and {r["score"] for r in score_toxicity(docs, None).collect()} == {0.0}


def test_toxicity_counts(spark):
    given = [(b"ab", 3, 0), (b"abcdefghij", 1, 2), (b"b", 0, 5), ("é".encode(), 1, 1)]
    model = Model.fit(spark.createDataFrame(given, "word binary, toxic long, ordinary long"))
    full, contexts, shared = brute.kneser_ney_counts(given)
    code = lambda g: int.from_bytes(g, "big") | len(g) << 56
    as_dict = lambda t: dict(zip(t.keys.tolist(), t.values.tolist(), strict=True))
    assert as_dict(model.grams) == {code(g): n for g, n in full.items()} and as_dict(model.contexts) == {code(g): n for g, n in contexts.items()}
    for (counts, totals, _), (grams, up) in zip(model.shared, shared, strict=True):
        assert as_dict(counts) == {code(g): [n] for g, n in grams.items()} and as_dict(totals) == {code(g): n for g, n in up.items()}
    words = [w for w, *_ in given] + [b"abc", b"zz", b"abcdefgh"]
    flat = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    want = [brute.kneser_ney_ratio(given, w) for w in words]
    assert np.allclose(model.ratios(flat, ends - [len(w) for w in words], ends), want, atol=1e-4) and abs(want[0]) > 0.1


def test_continuations_count_preceding_letters(spark):
    """'xa' occurs in five words, but only one byte ever precedes it."""
    model = Model.fit(spark.createDataFrame([(w, 1, 1) for w in (b"xa", b"xab", b"xac", b"xad", b"xae", b"ya")], "word binary, toxic long, ordinary long"))
    one = lambda n, g: model.shared[n][0].get(np.array([int.from_bytes(g, "big") | len(g) << 56], np.uint64))[0, 0]
    assert one(1, b"xa") == 1 and one(0, b"a") == 2 and one(0, b" ") == 5


def test_toxicity_learns_from_more_than_2000_rows_a_class(spark):
    table = spark.range(6000).selectExpr("id doc_id", "if(id % 2 = 1, 'ab', 'cd') text", "cast(id % 2 as int) toxic")
    learned = fit_toxicity(table, table).model.grams.values.sum(axis=0) / 3  # three places a word
    assert min(learned) > 2000


def test_url_filter(spark):
    cases = {
        "http://a.example.net/x": ("a.example.net", "/x", "net/", "block"), "http://A.Example.NET/en/1?q#f": ("a.example.net", "/en/1", "example.net/en/", "allow"), "https://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
        "https://badexample.com/de/": ("badexample.com", "/de/", None, "allow"), "http://x.org/fr/a": ("x.org", "/fr/a", "org/fr/", "allow"), "http://spam-farm.example.org/fr/a": ("spam-farm.example.org", "/fr/a", "org/fr/", "allow"),
        "http://www.spam-farm.example.org/q": ("www.spam-farm.example.org", "/q", None, "block"), "http://a.net?x=/y": ("a.net", "", None, "allow"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "://net/": ("net", "/", "net/", "block"),
    }
    table = spark.createDataFrame([(k, u, "z") for k, u in enumerate(cases)] + [(0, next(iter(cases)), "z"), (None, None, None)], "page_id long, url string, host string")
    got = filter_urls(table).collect()
    assert len(got) == len(cases) + 2
    for k, want in enumerate(cases.values()):
        assert {(r["host"], r["path"], r["rule"], r["verdict"]) for r in got if r["page_id"] == k} == {want}
    assert filter_urls(table.limit(0)).count() == 0


def test_digest_collisions_decide_nothing(spark):
    from gridloom.llm.url_filter import DigestArray, Probe, Shard, key_of

    clash = key_of(b"c/")
    shard = Shard(np.frombuffer(Shard.pack([(clash, b"a/", []), (clash, b"b/", []), (clash + 1, b"d/", [])]), np.uint8))
    assert shard.find(np.array([clash, clash, clash, clash + 1], np.uint64), [b"c/", b"b/", b"a/", b"c/"]) == [-1, 1, 0, -1]
    probe = Probe(DigestArray.of_list(spark, ["a/", "b/"]))  # as built, both are found
    assert probe.fits([["x.a", "a"], ["c"], [""]], ["/p", "/", ""]) == [["a/"], [], []]


def test_many_digest_shards_answer_like_one(spark):
    from gridloom.llm.url_filter import DigestArray, Probe

    rng = random.Random(4)
    rules = sorted({f"h{rng.randrange(400)}.t{rng.randrange(3)}/" + "p" * rng.randrange(6) for _ in range(3000)})
    table = spark.createDataFrame([(r,) for r in rules] * 2 + [(None,)], "rule string")
    many, one = DigestArray.of_table(table, 200), DigestArray.of_list(spark, rules)
    assert len(many.least) > 10 and (np.diff(many.least.astype(object)) > 0).all() and len(one.least) == 1
    hosts = [[f"www.h{k}.t{k % 4}", f"h{k}.t{k % 4}", f"t{k % 4}"] for k in range(420)]
    paths = ["/" + "p" * (k % 7) for k in range(420)]
    want = [[h + p[:n] for h in hs for n in range(1, len(p) + 1) if h + p[:n] in set(rules)] for hs, p in zip(hosts, paths, strict=True)]
    assert Probe(many).fits(hosts, paths) == want == Probe(one).fits(hosts, paths)
    assert len(DigestArray.of_table(table.limit(0)).least) == 0


def test_url_rules_from_a_table(spark):
    """A list made by Spark; keys are Spark's own xxhash64; files lie in the shared folder."""
    rules = spark.range(200_000).selectExpr("concat('host', id, '.test/p/') as rule").unionByName(spark.createDataFrame([(None,), ("bücher.test/",)], "rule string"))
    pages = spark.createDataFrame([(1, "http://a.host7.test/p/x"), (2, "http://host7.test/q"), (3, "https://bücher.test/y"), (4, "http://host200000.test/p/"), (5, "http://x.net/")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in filter_urls(pages, blocklist=rules).collect()}
    assert got == {1: (None, "block"), 2: (None, "allow"), 3: (None, "block"), 4: (None, "allow"), 5: ("net/", "block")}


def test_words_of_a_very_long_text_take_little_memory():
    import tracemalloc

    import pyarrow as pa

    from gridloom.llm import substring_dedup
    from gridloom.llm import words as W

    text = " ".join(f"word{k % 9973} and some more text {k}" for k in range(600_000)) + "\n"
    assert len(text) > 18 << 20
    (part,) = W.slices(pa.array([text], pa.large_string()))
    for run in (lambda: W.words(part, W.ALNUM), lambda: substring_dedup._runs(part, 50, 18)):
        tracemalloc.start()
        run()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 15 * len(text)
    w = W.words(part, W.ALNUM)
    for k in (0, 1, 777_777, len(w.starts) - 1):  # the same hash as in a slice of its own
        word = w.low[w.starts[k] : w.ends[k]]
        assert W.hash_spans(word, np.array([0]), np.array([len(word)]))[0] == w.hashes[k]


def test_jaccard_of_many_sets_under_one_shingle(spark, monkeypatch):
    """Thousands of sets listed under the same frequent shingles, some linked far from the hub."""
    from gridloom.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "PIVOTS", 8)
    monkeypatch.setattr(jaccard_join, "PIVOT_GROUP", 3)
    monkeypatch.setattr(jaccard_join, "MEMBER_GROUP", 50)
    monkeypatch.setattr(jaccard_join, "boundary", lambda sizes, percent: 0)
    common = [f"c{k}" for k in range(8)]
    rows = []
    for g in range(300):  # pairs of near copies: 40 own words, the last one differs
        own = [f"g{g}w{k}" for k in range(40)]
        rows += [(2 * g, " ".join(common + own)), (2 * g + 1, " ".join(common + own[:-1] + ["other"]))]
    want = {i: i - i % 2 for i, _ in rows}
    # an order in which the common shingles come first puts all sets into their lists
    import pyarrow as pa

    from gridloom.llm import words as W

    (part,) = W.slices(pa.array([" ".join(common) + "\n"]))
    table = np.ones(1 << jaccard_join.FREQUENT_BITS, np.uint32)
    table[jaccard_join._sets(part, 4)[0] >> np.uint64(64 - jaccard_join.FREQUENT_BITS)] = 0
    monkeypatch.setattr(jaccard_join, "_statistics", lambda shown, k, percent: (table, 0))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_an_id_with_two_texts_links_their_classes(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    docs = spark.createDataFrame([(5, a), (5, b), (3, a), (4, b), (6, ""), (None, b)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in jaccard_components(docs).collect()) == [(0, 3), (3, 3), (4, 3), (5, 3), (5, 3), (6, 6)]


def test_only_pieces_with_an_answer_come_back_to_their_segments(spark, monkeypatch):
    """A common phrase in surroundings of one text each: none but pieces that two texts have are joined, others are nobody's."""
    from gridloom.llm import substring_dedup as dedup

    monkeypatch.setattr(dedup, "CROWD", 4)
    rng = np.random.default_rng(8)
    word = lambda n: bytes(rng.integers(97, 123, n).tolist())
    phrase, end = word(60), word(30)
    texts = [word(20) + phrase[:45] + (end if i in (3, 11) else word(30)) for i in range(40)]
    rows = [(0, 7, t, i, i) for i, t in enumerate(texts)]
    segments = spark.createDataFrame(rows, "part int, key long, segment binary, lo long, hi long")
    got = {bytes(r["segment"]): r["least"] for r in dedup._answers(segments, 50, [18, 42, 50], 4, 1).collect()}
    want = {t: [min(j for j, o in enumerate(texts) if t[k : k + 50] in o) for k in range(len(t) - 49)] for t in texts}
    assert set(got) == {texts[3], texts[11]}
    nobody = (1 << 63) - 1
    assert [min(x, 11) for x in got[texts[11]]] == want[texts[11]] and nobody in got[texts[11]]


def test_only_pieces_that_two_segments_have_are_dealt_on(spark, monkeypatch):
    """A common phrase in surroundings of one text each: rows grow with what is shared, not with the segments' strings; the owner of the rest is the segment's."""
    from gridloom.llm import substring_dedup as dedup

    rows = []
    monkeypatch.setattr(dedup, "CROWD", 4)
    monkeypatch.setattr(dedup, "cut", lambda df, cut=dedup.cut: [held := cut(df), "at" in df.columns and rows.append(held.count())][0])
    rng = np.random.default_rng(9)
    word = lambda n: bytes(rng.integers(97, 123, n).tolist())
    phrase, end = word(45), word(30)
    texts = [word(20) + phrase + (end if i in (3, 11) else word(30)) for i in range(40)]
    ids = [(i, 90 + i if i in (5, 11) else i) for i in range(40)]
    segments = spark.createDataFrame([(0, 7, t, *ids[i]) for i, t in enumerate(texts)], "part int, key long, segment binary, lo long, hi long")
    got = {bytes(r["segment"]): r["least"] for r in dedup._answers(segments, 50, [18, 42, 50], 4, 1).collect()}
    want = {t: [min(ids[j][0] for j, o in enumerate(texts) if t[k : k + 50] in o) for k in range(len(t) - 49)] for t in texts}
    assert set(got) == {texts[i] for i in (3, 5, 11)}
    assert got[texts[5]] == want[texts[5]] == [5] * 46 and got[texts[11]] == want[texts[11]]
    assert [min(x, 3) for x in got[texts[3]]] == want[texts[3]]
    # a 42-byte gram of the phrase rules at most 13 of a text's 46 strings; all pieces were some 300
    assert rows and rows[0] <= 40 * 5 and sum(rows[1:]) <= 2 * 46
