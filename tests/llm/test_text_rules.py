import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plexmill.llm import kernels, licenses, quality, sharding, toxicity, weaklabel

from .helpers import documents, lowered, prose, texts, words


def test_shards_keep_the_law(spark):
    rows = texts()
    got = sharding.digest(sharding.shard(documents(spark, rows))).collect()
    assert sorted((g.doc_id or -1, g.size, g.text_crc32) for g in got) == sorted((i or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = collections.defaultdict(list)
    for g in got:
        slots[g["shard"]].append(g.slot)
        assert g.law == "key" and 0 <= g["shard"] < 24 and g.grown_shard in (g["shard"], 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = {(g.doc_id, g.text_crc32, g.slot): g["shard"] for g in sharding.digest(sharding.shard(documents(spark, rows).repartition(3))).collect()}
    assert again == {(g.doc_id, g.text_crc32, g.slot): g["shard"] for g in got}
    assert sharding.digest(sharding.shard(documents(spark, []))).collect() == []


def test_shards_spread_and_split_hot_buckets(spark):
    df = documents(spark, [(k, "t") for k in range(4000)] + [(5, "hot")] * 300)
    cfg = sharding.ShardConfig(bucket_rows=100)
    got = sharding.digest(sharding.shard(df, cfg)).toPandas()
    assert len(got) == 4300
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    sizes = got[got.text_crc32 == zlib.crc32(b"t")].groupby("shard").size()
    assert sizes.min() > 110 and sizes.max() < 230


def test_repeated_rows_are_dealt_to_all_buckets_of_their_shard(spark):
    rows = [(5, "hot")] * 2000 + [(k, "t") for k in range(100, 400)] + [(None, "n"), (-(1 << 63), "least")]
    made = sharding.shard(documents(spark, rows), sharding.ShardConfig(bucket_rows=100, shards=6))
    got = [r.asDict() for r in made.slotted().collect()]
    assert len(got) == len(rows)
    hot = collections.Counter(r["bucket"] for r in got if r["doc_id"] == 5)
    assert len(hot) >= 20 and max(hot.values()) < 160 and len({r["shard"] for r in got if r["doc_id"] == 5}) == 1
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_fisher_yates_makes_every_order_as_likely():
    seen = collections.Counter(tuple(sharding.fisher_yates(4, 20, b)) for b in range(24_000))
    assert len(seen) == 24 and min(seen.values()) > 850 and max(seen.values()) < 1150
    # Against a plain version: the same draws, a list, one pick at a time.
    for n in (1, 2, 17, 400):
        left, order = list(range(n)), []
        for p in np.random.Generator(np.random.PCG64([20, 3])).integers(0, np.arange(n, 0, -1)).tolist():
            left[0], left[p] = left[p], left[0]
            order.append(left.pop(0))
        assert sharding.fisher_yates(n, 20, 3).tolist() == order


def base_counts(text):
    w = words(text)
    k = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(k)
    covered = {j for i, x in enumerate(k) if n[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_base_counts(spark):
    rows = [*texts(), (500, "a b c a b c a b " * 30), (501, "one two three four\n" * 3), (502, "#*$ %&| <> ok")]
    got = quality.judge(documents(spark, rows)).collect()
    want = sorted(((i or -1, *base_counts(t)) for i, t in rows))
    assert sorted((g.doc_id or -1, g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) for g in got) == want
    for g in got:
        assert g.base_failed == (g.n_words < 50 or 100 * g.n_repeat_words > 50 * g.n_words)
        assert not (g.base_failed and g.kept)
    assert quality.judge(documents(spark, [])).collect() == []


def test_quality_rejects_divergence_and_keeps_prose(spark):
    r = np.random.default_rng(1)
    common = quality.COMMON_WORDS["en"].split()
    def clean(k):
        return " ".join((str(r.choice(common)) if r.random() < 0.4 else f"w{chr(97 + k % 26)}{chr(97 + j % 26)}{chr(97 + j // 26)}ord") for j in range(300)) + "."
    rows = [(k, clean(k)) for k in range(60)] + [(900, " ".join(f"{x}***%%%" for x in prose(3, 120).split())), (901, " | ".join(f"q{chr(97 + k % 26)}{chr(97 + k // 26)}{k % 7}" for k in range(300)))]
    got = {g.doc_id: g for g in quality.judge(documents(spark, rows)).collect()}
    assert all(got[k].kept for k in range(60))
    assert not got[900].kept and not got[901].kept
    kept = quality.keep_good(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns and kept.count() == sum(g.kept for g in got.values())


def plain_quality(rows, cfg=quality.QualityConfig()):
    """(n_words, kept) of each (text, language), by counting characters and words one by one."""
    in_class = [lambda c: c in quality.WHITE, lambda c: c in quality.SYMBOLS, lambda c: "A" <= c <= "Z", lambda c: c in "0123456789", lambda c: c in quality.PUNCTUATION]

    def histograms(text, lang):
        chars = [sum(map(f, text)) for f in in_class]
        chars.append(len(text) - sum(chars))
        known = cfg.words.get(lang, "").split()
        plain = [w.lower().rstrip(quality.MARKS) if len(w) <= 7 else "" for w in words(text)]
        common = [plain.count(k) for k in known] + [0] * (20 - len(known))
        return np.array(chars, float), np.array([*common, len(plain) - sum(common)], float)

    def distance(a, b):
        p, q = a / a.sum(), b / b.sum()
        m = (p + q) / 2
        half = lambda x: sum(v * np.log2(v / w) for v, w in zip(x, m, strict=True) if v > 0) / 2
        return np.sqrt(max(0.0, half(p) + half(q)))

    made = [(t or "", lang, *histograms(t or "", lang), base_counts(t)) for t, lang in rows]
    failed = [c[0] < cfg.least_words or 100 * c[4] > cfg.most_repeat_percent * c[0] for *_, c in made]

    def references(use):
        out = {}
        for lang in cfg.words:
            own = [m for m, u in zip(made, use, strict=True) if u and m[1] == lang]
            if own:
                out[lang] = sum(m[2] for m in own), sum(m[3] for m in own)
        return out

    def near(refs):
        ok = []
        for text, lang, chars, common, c in made:
            n, fine = c[0], True
            if len(text) >= cfg.guard_chars and refs:
                d = distance(chars, refs[lang][0]) if lang in refs else min(distance(chars, r[0]) for r in refs.values())
                fine &= d <= np.sqrt(cfg.most_char_distance**2 + cfg.char_chance / max(n, 1))
            if n >= cfg.guard_words and lang in refs:
                fine &= distance(common, refs[lang][1]) <= np.sqrt(cfg.most_word_distance**2 + cfg.word_chance / max(n, 1))
            ok.append(fine)
        return ok

    passed = [not f for f in failed]
    settled = references([a and b for a, b in zip(near(references(passed)), passed, strict=True)])
    return [(m[4][0], p and k) for m, p, k in zip(made, passed, near(settled), strict=True)]


def test_quality_verdict_agrees_with_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en"), (9002, "", None), (9003, prose(4, 90), None), (9004, prose(5, 80), "xx"), (9005, "a b " * 40, "en"), (9006, "The, of. AND! " * 30, "en")], "doc_id long, text string, lang string")
    rows = docs.select("doc_id", "text", "lang").unionByName(extra)
    local = rows.collect()
    want = plain_quality([(r.text, r.lang) for r in local])
    got = {g.doc_id: (g.n_words, g.kept) for g in quality.judge(rows).collect()}
    assert got == {r.doc_id: w for r, w in zip(local, want, strict=True)}
    assert 20 < sum(k for _, k in want) < len(want) - 20
    kept = quality.keep_good(rows)
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, k) in got.items() if k}


def test_guards_leave_short_histograms_unjudged(spark):
    odd = " ".join("q%x" % k for k in range(55))
    rows = [(k, prose(k, 200)) for k in range(20)] + [(100, odd), (101, odd + " " + " ".join("%x&&|" % k for k in range(100)))]
    got = {g.doc_id: g for g in quality.judge(documents(spark, rows)).collect()}
    assert got[100].char_distance is None and got[100].word_distance is None and got[100].kept
    assert got[101].char_distance is not None and not got[101].kept


def test_js_distance_is_right(spark):
    p, q = np.array([1.0, 2, 0, 5]), np.array([2.0, 2, 3, 1])
    a, b = p / p.sum(), q / q.sum()
    m = (a + b) / 2
    kl = lambda x: sum(v * np.log2(v / w) for v, w in zip(x, m, strict=True) if v > 0)
    lit = lambda v: F.array(*map(F.lit, v.tolist()))
    got = spark.range(1).select(quality._js_distance(quality._shares(lit(p)), quality._shares(lit(q))).alias("d")).first().d
    assert got == pytest.approx(np.sqrt((kl(a) + kl(b)) / 2))


def test_quality_runs_no_python(spark):
    docs = documents(spark)
    for df in (quality.features(docs), quality.judge(docs), quality.keep_good(docs)):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def toxic_fixture(spark):
    bad = ["vileword", "nastyterm", "grimnoun"]
    rows, labels = [], []
    r = np.random.default_rng(2)
    for k in range(400):
        toxic = int(k % 5 == 0)
        t = prose(1000 + k, 40) + (" " + " ".join(r.choice(bad, 3)) if toxic else "")
        rows.append((k, t))
        labels.append((k, toxic))
    return rows, labels


def test_toxicity_is_right_on_rows_never_learnt_from(spark):
    rows, labels = toxic_fixture(spark)
    lab = spark.createDataFrame([*labels, (3, None), (None, 1), (5, 0)], "doc_id long, toxic int")
    got = toxicity.decisions(toxicity.score_toxicity(documents(spark, [*rows, *texts()]), lab)).collect()
    truth = dict(labels)
    held = [g for g in got if g.held_out and g.doc_id in truth and g.doc_id > 22 and not 100 <= g.doc_id < 120]
    assert len(held) > 80 and all((zlib.crc32(str(g.doc_id).encode()) % 3 == 1) for g in held)
    assert sum(g.predicted == truth[g.doc_id] for g in held) / len(held) > 0.98
    assert all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.7) for g in got) and len(got) == len(rows) + len(texts())
    assert all(zlib.crc32(str(e).encode()) % 3 != 1 for g in got for e in g.evidence)
    kept = toxicity.drop_toxic(documents(spark, rows), lab)
    assert kept.columns == documents(spark, []).columns
    left = {r.doc_id for r in kept.select("doc_id").collect()}
    assert sum((k in left) == (t == 0) for k, t in labels) / len(labels) > 0.98


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {g.score for g in toxicity.score_toxicity(documents(spark), none).collect()} == {0.5}
    assert toxicity.score_toxicity(documents(spark, []), none).collect() == []


def test_block_max_search_is_exact():
    r = np.random.default_rng(4)
    cfg = toxicity.ToxicityConfig(block=8, neighbours=7)
    examples = []
    for d in range(500):
        t = np.sort(r.choice(60, r.integers(1, 8), replace=False)).astype("<i4")
        examples.append((d, int(d % 4 == 0), t.tobytes()))
    index = toxicity.BlockMaxIndex(60, examples, cfg)
    dense = np.zeros((len(index.rows), 60))
    for t in range(60):
        for b in range(index.blocks):
            lo, hi = index.start[t * index.blocks + b], index.start[t * index.blocks + b + 1]
            dense[index.where[lo:hi], t] = index.weight[lo:hi]
    for _ in range(50):
        t = np.sort(r.choice(60, 5, replace=False)).astype("<i4")
        q = np.zeros(60)
        q[t] = index.idf[t] / np.linalg.norm(index.idf[t])
        sim = dense @ q
        got = index.nearest(t)
        assert np.allclose([c for c, _ in got], np.sort(sim)[::-1][: len(got)]) and len(got) == min(7, int((sim > 0).sum()))
        assert np.allclose([sim[i] for _, i in got], [c for c, _ in got])


def whole_text_cosines(texts, examples):
    """Brute force: TF-IDF cosines over words of letters and their first four and five characters."""

    def terms(t):
        w = re.findall("[^\x00-\x60\x7b-\x7f]+", lowered(t))
        return collections.Counter([*w, *(("head", x[:n]) for n in (4, 5) for x in w if len(x) > n)])

    bags = [terms(t) for t in examples]
    df = collections.Counter(x for b in bags for x in b)

    def vector(bag):
        v = {x: (1 + np.log(n)) * (np.log((len(examples) + 1) / (df[x] + 1)) + 1) for x, n in bag.items()}
        norm = np.sqrt(sum(x * x for x in v.values()))
        return {x: y / norm for x, y in v.items()}

    known = [vector(b) for b in bags]
    return np.array([[sum(y * k.get(x, 0) for x, y in v.items()) for k in known] for v in (vector(terms(t)) for t in texts)])


@pytest.mark.parametrize("near", [1e-9, 0.3, 0.5])
@pytest.mark.parametrize("frequent", [0.0, 0.1, 2.0])
def test_whole_text_search_is_exact(frequent, near):
    examples = [prose(k, 5 + k % 60) for k in range(120)] + ["only rare wording", "überaus été", "1 2 3"]
    queries = [*examples[::9], *(prose(500 + k, 1 + 7 * k) for k in range(30)), "", "unseen unheard", "rare", prose(9, 20) + " unseen"]
    cfg = toxicity.ToxicityConfig(frequent=frequent, neighbours=7, near=near)
    batch = pa.record_batch({"doc_id": pa.array(range(len(examples))), "toxic": pa.array([k % 2 for k in range(len(examples))], pa.int32()), "text": pa.array(examples)})
    index = toxicity.WholeTextIndex(toxicity.ExampleRows.read(pa.Table.from_batches(toxicity._example_rows(cfg)([batch]))), cfg)
    ((_, _, t),) = toxicity._text_terms(pa.array(queries), cfg)
    number = toxicity._index_of(index.terms, t.hashes)[t.term]
    known = number >= 0
    others = np.bincount(t.owner[~known], (1 + np.log(t.count[~known])) ** 2, minlength=len(queries))
    got = list(index.nearest(np.searchsorted(t.owner[known], np.arange(len(queries) + 1)), number[known], t.count[known], others))
    for (cosine, at), want in zip(got, whole_text_cosines(queries, examples), strict=True):
        assert len(at) == min(7, int((want >= near).sum()))
        assert np.allclose(cosine, np.sort(want)[::-1][: len(at)], atol=1e-6) and np.allclose(want[index.doc[at]], cosine, atol=1e-6)


def test_terms_of_a_text_in_pieces_are_those_of_the_whole(monkeypatch):
    cfg = toxicity.ToxicityConfig()
    long = [prose(7, 3000), "stem1 stemtwo stemthree stemtwo", "", prose(8, 2000)]
    whole = [t for _, _, t in toxicity._text_terms(pa.array(long), cfg)]
    pieces = kernels.row_pieces
    monkeypatch.setattr(kernels, "row_pieces", lambda column: pieces(column, 700))
    parts = [t for _, _, t in toxicity._text_terms(pa.array(long), cfg)]
    bag = lambda ts: [sorted(zip(t.hashes[t.term[t.owner == i]].tolist(), t.count[t.owner == i].tolist(), strict=True)) for t in ts for i in range(len(t.words))]
    assert bag(whole) == bag(parts) and [int(n) for t in whole for n in t.words] == [int(n) for t in parts for n in t.words]


def test_variants_are_levels_and_rates():
    cfg = toxicity.ToxicityConfig()
    h, n, words = np.arange(1, 5, dtype=np.uint64), np.array([1, 2, 3, 9]), np.array([100, 100, 1000, 100])
    place, _ = toxicity._variants(h, n, words, cfg)
    # Itself; at least 2, 3, 5; and a rate if it is there twice.
    assert np.bincount(place).tolist() == [1, 3, 4, 5]
    same = lambda a, b: {*toxicity._variants(*a, cfg)[1].tolist()} & {*toxicity._variants(*b, cfg)[1].tolist()}
    one = np.array([7], np.uint64)
    assert len(same((one, np.array([3]), np.array([50])), (one, np.array([6]), np.array([100])))) == 4
    assert len(same((one, np.array([3]), np.array([50])), (one, np.array([3]), np.array([5000])))) == 3


def test_held_out_rows_are_found_in_every_language(spark):
    """Held-out recall and precision over the labels of sf0.1, by language."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.decisions(toxicity.score_toxicity(docs, labels)).where("held_out").drop("held_out")
    rows = scored.join(labels.where("toxic is not null"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    found = collections.defaultdict(list)
    for r in rows:
        found[r.lang].append((r.toxic, r.predicted))
    pairs = [x for v in found.values() for x in v]
    recall = lambda v: sum(p for t, p in v if t) / max(1, sum(t for t, _ in v))
    precision = sum(t for t, p in pairs if p) / sum(p for _, p in pairs)
    print({k: (sum(p for t, p in v if t), sum(t for t, _ in v)) for k, v in found.items()}, recall(pairs), precision)
    assert recall(pairs) >= 0.9 and precision >= 0.97
    assert all(recall(found[k]) >= 0.9 for k in ("en", "fr", "de", "es"))


def plain_toxicity(examples, queries, cfg):
    """Scores of texts by examples (label, text): terms, variants, likelihood ratios, cosines and votes one by one."""

    def bag(t):
        w = re.findall("[^\x00-\x60\x7b-\x7f]+", lowered(t))
        return collections.Counter([*w, *(("head", x[:n]) for n in cfg.prefixes for x in w if len(x) > n)]), len(w)

    def variants(t):
        b, n = bag(t)
        out = set(b) | {(x, "at least", k) for x, c in b.items() for k in cfg.levels if c >= k}
        return out | {(x, "rate", int(np.floor(np.log2(c * 1000 / n)))) for x, c in b.items() if c >= 2}

    rows, toxic = collections.Counter(), collections.Counter()
    for label, t in examples:
        rows.update(variants(t))
        toxic.update(variants(t) if label else ())
    share = sum(x for x, _ in examples) / len(examples)
    least = 2 * np.log(max(2, sum(n > 1 for n in rows.values())))

    def ratio(a, n):
        return 2 * sum(x * np.log(x / (n * q)) for x, q in ((a, share), (n - a, 1 - share)) if x)

    telling = {x for x, n in rows.items() if toxic[x] > cfg.lean * share * n and ratio(toxic[x], n) >= least}
    own = [frozenset(variants(t) & telling) for _, t in examples]
    df = collections.Counter(x for v in own for x in v)
    idf = {x: np.log((len(examples) + 1) / (df[x] + 1)) + 1 for x in telling}
    merged = collections.defaultdict(lambda: [0, 0])
    for v, (label, _) in zip(own, examples, strict=True):
        merged[v][0] += 1
        merged[v][1] += label
    empty = merged.pop(frozenset(), [0, 0])
    n, bad = (sum(m[k] for m in merged.values()) for k in (0, 1))
    everyone = (bad + empty[1] + 1) / (n + empty[0] + 2)
    norm = lambda v: np.sqrt(sum(idf[x] ** 2 for x in v))
    distinct = collections.defaultdict(lambda: [0, 0])
    for label, t in examples:
        if bag(t)[0]:
            distinct[t][0] += 1
            distinct[t][1] += label
    known = list(distinct)
    cosines = whole_text_cosines(queries, [t for _, t in examples])
    first = [[t for _, t in examples].index(k) for k in known]
    scores = []
    for q, cos in zip(queries, cosines[:, first], strict=True):
        v = variants(q) & telling
        prior = (empty[1] + everyone) / (empty[0] + 1)
        if v:
            near = sorted((sum(idf[x] ** 2 for x in v & k) / norm(v) / norm(k), m) for k, m in merged.items() if v & k)[-cfg.neighbours :]
            up = sum(c**cfg.sharpness * m[1] for c, m in near) + cfg.prior_votes * (bad + everyone) / (n + 1)
            prior = up / (sum(c**cfg.sharpness * m[0] for c, m in near) + cfg.prior_votes)
        votes = sorted((c, distinct[k], v <= own[f]) for c, k, f in zip(cos, known, first, strict=True) if c >= cfg.near)[-cfg.neighbours :]

        def vote(votes, prior=prior):
            weight = [(c**cfg.sharpness / (max(0, 1 - c) + cfg.softness), m) for c, m, _ in votes]
            return (sum(w * m[1] for w, m in weight) + cfg.prior_votes * prior) / (sum(w * m[0] for w, m in weight) + cfg.prior_votes)

        voted = vote(votes)
        scores.append(voted if voted >= prior else min(prior, vote([x for x in votes if x[2]])))
    return scores


def test_scores_agree_with_a_plain_version(spark):
    rows, labels = toxic_fixture(spark)
    rows = [(i, t + " vileword" * (i % 7 if y else 0)) for (i, t), (_, y) in zip(rows, labels, strict=True)]
    cfg = toxicity.ToxicityConfig(neighbours=1000)  # no ties for the last place
    more = [(5000, ""), (5001, None), (5002, "vileword"), (5003, "vileword vileword vileword some words"), (5004, rows[0][1] + " end"), (5005, "1 2 3"), (5006, rows[1][1])]
    got = {g.doc_id: g.score for g in toxicity.score_toxicity(documents(spark, rows + more), spark.createDataFrame(labels, "doc_id long, toxic int"), cfg).collect()}
    learnt = [(y, t) for (i, t), (_, y) in zip(rows, labels, strict=True) if zlib.crc32(str(i).encode()) % 3 != 1]
    queries = more + rows[:60]
    want = plain_toxicity(learnt, [t or "" for _, t in queries], cfg)
    assert all(abs(got[i] - w) < 1e-5 for (i, _), w in zip(queries, want, strict=True))
    assert max(want) > 0.9 and min(want) < 0.1


def test_a_text_like_a_clean_one_is_lowered_unless_it_has_more_telling_terms(spark):
    rows, labels = toxic_fixture(spark)
    word = next(w for w in rows[next(k for k, (_, y) in enumerate(labels) if y)][1].split()[::-1])
    clean = prose(7000, 60) + f" {word}"
    ids = [k for k in range(1000, 1200) if zlib.crc32(str(k).encode()) % 3 != 1][:6]
    lab = spark.createDataFrame([*labels, *((k, 0) for k in ids)], "doc_id long, toxic int")
    docs = documents(spark, [*rows, *((k, clean + f" x{k}") for k in ids), (3000, clean), (3001, clean.replace(word, "")), (3002, prose(7001, 60) + f" {word}")])
    got = {g.doc_id: g.score for g in toxicity.score_toxicity(docs, lab).collect()}
    assert got[3000] < 0.3 and got[3001] < 0.1 and got[3002] > got[3000]


def test_scores_are_calibrated(spark):
    """Held-out rows by their score: the share of toxic ones lies near the mean score of a bin."""
    rows, labels = toxic_fixture(spark)
    r = random.Random(3)
    labels = [(k, y if r.random() > 0.1 else 1 - y) for k, y in labels]  # noise that scores have to own up to
    got = {g.doc_id: g.score for g in toxicity.score_toxicity(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [(got[k], y) for k, y in labels if zlib.crc32(str(k).encode()) % 3 == 1]
    brier = sum((s - y) ** 2 for s, y in held) / len(held)
    share = sum(y for _, y in held) / len(held)
    assert brier < 0.7 * share * (1 - share)
    for own in ([x for x in held if x[0] < 0.5], [x for x in held if x[0] >= 0.5]):
        assert abs(sum(s - y for s, y in own) / len(own)) < 0.12


def test_repeats_of_a_labelled_id_are_one_example_and_texts_are_bounded(spark):
    rows, labels = toxic_fixture(spark)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    learnt = next(k for k, y in labels if y and zlib.crc32(str(k).encode()) % 3 != 1)
    text = dict(rows)[learnt]
    docs = documents(spark, rows)
    many = docs.unionByName(docs.where(f"doc_id = {learnt}").crossJoin(spark.range(20_000)).drop("id"))
    plain, repeated = toxicity.fit(docs, lab), toxicity.fit(many, lab)
    assert sorted(plain.whole.doc.tolist()) == sorted(repeated.whole.doc.tolist())
    assert plain.whole.rows.sum() == repeated.whole.rows.sum()
    other = documents(spark, [*rows, *((learnt, f"{text} v{k}") for k in range(3000))])
    assert toxicity.fit(other, lab, toxicity.ToxicityConfig(sample=500)).whole.rows.sum() <= 500
    long = documents(spark, [*rows, (learnt, "word " * 300_000)])
    cfg = toxicity.ToxicityConfig(sample_mb=1)
    assert toxicity.fit(long, lab, cfg).whole.rows.sum() == plain.whole.rows.sum()


def test_texts_near_a_toxic_example_of_rare_wording_are_toxic(spark):
    rows, labels = toxic_fixture(spark)
    rare = [" ".join(f"{a}{b}seldom" for b in "abcdefghijklmnopqrst") for a in ("u", "v")]
    ids = [k for k in range(1000, 1100) if zlib.crc32(str(k).encode()) % 3 != 1][:2]
    new = [(2000, rare[0]), (2001, rare[1] + " further"), (2002, "wholly other wording")]
    lab = spark.createDataFrame([*labels, *((k, 1) for k in ids)], "doc_id long, toxic int")
    docs = documents(spark, [*rows, *zip(ids, rare, strict=True), *new])
    got = {g.doc_id: g for g in toxicity.decisions(toxicity.score_toxicity(docs, lab)).collect()}
    assert [got[k].predicted for k in (2000, 2001, 2002)] == [1, 1, 0]
    assert got[2000].evidence[0] == ids[0] and got[2001].evidence[0] == ids[1]
    assert not {2000, 2001} & {r.doc_id for r in toxicity.drop_toxic(docs, lab).select("doc_id").collect()}


def phrase_places(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text or ""))
    at = [(i, x) for p, x in licenses.BASE_PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), at


def test_licence_phrases_and_labels(spark):
    rows = [
        *texts(), (600, "cc by cc by-nc general public license"), (601, "Permission is hereby granted, free of charge, to any person " + licenses.TEMPLATES[2][1][58:]),
        (602, "ccby c c by"), (603, "released under the MIT License " * 3), (604, "general public\nlicense all rights cc by reserved"),
    ]
    got = licenses.scan_licenses(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    keyed = collections.Counter((g.doc_id, g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) for g in got)
    want = collections.Counter()
    for i, t in rows:
        n, at = phrase_places(t)
        p = [a for a, _ in at]
        want[i, n, len(at), min(p, default=None), max(p, default=None), ",".join(sorted({x for _, x in at}))] += 1
    assert keyed == want
    by = {g.doc_id: g for g in got}
    assert "mit" in by[601].labels.split(",") and by[603].labels == "mit" and by[602].labels == "cc-by" if by[602].n_base else True
    assert "cc-by-nc-4.0" in by[17].labels and by[17].score == 1.0 and by[8].score == 0
    for g in got:
        assert set(filter(None, g.base_labels.split(","))) <= set(filter(None, g.labels.split(",")))
    assert licenses.scan_licenses(documents(spark, [])).collect() == []


def test_templates_are_found_with_changes_and_not_in_part(spark):
    rows, want = [], {}
    for k, (label, text) in enumerate(licenses.TEMPLATES):
        w = re.findall(r"[A-Za-z0-9]+", text)
        changed = [*w]
        if len(w) >= 15:  # one word in the middle is another
            changed[len(w) // 2] = "otherwise"
        for j, (t, found) in enumerate(((text, True), (" ".join(changed), True), (" ".join(w[: len(w) // 3]), False))):
            rows.append((10 * k + j, f"{prose(k, 30)} {t} {prose(k + 50, 30)}"))
            want[10 * k + j] = (label, found)
    got = {g.doc_id: g for g in licenses.scan_licenses(documents(spark, rows)).collect()}
    for i, (label, found) in want.items():
        assert (label in [s.label for s in got[i].spans]) == found, rows[i % 10 + 3 * (i // 10)]
        for s in got[i].spans:
            assert s.cover >= 0.8 and 30 <= s.first_word < s.end_word <= got[i].n_words - 30


def test_suffix_automaton_gives_matching_statistics():
    cfg = licenses.LicenseConfig(phrases={"a b": "x"}, templates=(("t", "a b c a b d"), ("u", "c a b a"), ("v", "b b a b c")))
    sa = licenses.SuffixAutomaton(cfg)
    grams = {tuple(t[i:j]) for t in [*sa.texts, *sa.phrases] for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    vocabulary = sorted({w for t in [*sa.texts, *sa.phrases] for w in t})
    r = np.random.default_rng(6)
    text = r.integers(0, len(vocabulary), 400).astype(np.int32)
    state, match = sa.statistics(text, np.array([0]), np.array([400]))
    names = [vocabulary[i] for i in text]
    for i in range(400):
        best = max((k for k in range(0, 8) if k == 0 or (i - k + 1 >= 0 and tuple(names[i - k + 1 : i + 1]) in grams)), default=0)
        assert match[i] == best
        assert (names[max(0, i - 1) : i + 1] == [b"a", b"b"]) == bool(sa.inherits[0][state[i]] or (state[i] == sa.phrase_state[0] and match[i] >= 2))


def test_weak_labels_find_junk(spark):
    rows = [(k, " ".join(f"{x} {quality.COMMON_WORDS['en'].split()[(k * j) % 20]}" for j, x in enumerate(prose(k, 60).split()))) for k in range(1, 121)] + [(500 + k, " ".join(f"{x}***%%% |" for x in prose(k, 80).split())) for k in range(15)]
    got = {g.doc_id: g for g in weaklabel.classify(documents(spark, rows)).collect()}
    assert all(got[k].kept for k in range(1, 121)) and not any(got[500 + k].kept for k in range(15))
    edge = weaklabel.classify(documents(spark)).collect()
    assert len(edge) == len(texts()) and all(0 <= g.score <= 1 for g in edge)
    assert weaklabel.classify(documents(spark, [])).collect() == []


def plain_votes(t):
    """Votes of one text in plain Python."""
    raw, w = t.encode(), words(lowered(t))
    n = len(w)
    windows = [tuple(w[k : k + 3]) for k in range(n - 2)]
    lines = [x for x in t.split("\n") if x]
    symbols = sum(c in "#*$%&|<>" for c in t) / max(len(raw), 1)
    digits = sum(c in "0123456789" for c in t) / max(len(raw), 1)
    common = {w for text in quality.COMMON_WORDS.values() for w in text.split()}
    mean = sum(len(x.encode()) for x in w) / max(n, 1)
    fresh = len(set(windows)) / len(windows) if windows else 1.0
    own, variety, usual = len(set(lines)) / max(len(lines), 1), len(set(w)) / max(n, 1), sum(x in common for x in w) / max(n, 1)
    vote = lambda good, bad: 1 if good else -1 if bad else 0
    enough = n >= 20
    return [
        vote(n >= 50, n < 1), vote(3 <= mean <= 7, mean < 2 or mean > 9), vote(symbols < 0.005, symbols > 0.02),
        vote(enough and fresh > 0.9, enough and fresh < 0.6), vote(len(lines) > 1 and own > 0.9, own < 0.7),
        vote(usual > 0.08, enough and usual < 0.02), vote(enough and variety > 0.3, enough and variety < 0.15), vote(enough and digits < 0.05, digits > 0.2),
    ]


def plain_hashed(t, dims):
    b = lowered(t).encode()
    row = np.zeros(dims)
    for k in range(len(b) - 2):
        x = (b[k] * 0x9E3779B1 + b[k + 1] * 0x85EBCA77 + b[k + 2] * 0xC2B2AE3D) % (1 << 32)
        row[(x >> 12) % dims] += 1
    row = np.sqrt(row)
    return row / max(np.linalg.norm(row), 1e-300)


def test_votes_and_features_agree_with_plain_versions():
    all_ = [t or "" for _, t in texts()] + ["a b c " * 30, "x\n" * 9 + "y", "12 34 56 78 #%&", "the of and to in is " * 10, prose(3, 200) + "\nthe of", "ab", "\n\n"]
    raw, offs = kernels.text_buffer(pa.array(all_))
    assert weaklabel.votes(raw, offs).tolist() == [plain_votes(t) for t in all_]
    assert np.allclose(weaklabel.hashed(raw, offs, 64), [plain_hashed(t, 64) for t in all_], atol=1e-6)


def test_classifier_agrees_with_a_plain_version(spark):
    rows = [(k, prose(k, 40 + 7 * k)) for k in range(12)] + [(50 + k, f"spam {k % 3} " * (30 + k % 3)) for k in range(30)] + [(90, None), (91, "")]
    cfg = weaklabel.WeakLabelConfig(dims=64, train_rounds=150)
    got = {r.doc_id: r for r in weaklabel.classify(documents(spark, rows), cfg).collect()}
    patterns = collections.Counter(tuple(plain_votes(t or "")) for _, t in rows)
    kinds = sorted(patterns, key=lambda p: np.array(p, np.int8).tobytes())
    post, _, _ = weaklabel.fit_labellers(np.array(kinds), np.array([patterns[k] for k in kinds], float), cfg.em_rounds)
    known = dict(zip(kinds, post, strict=True))
    often = collections.Counter(t or "" for _, t in rows)
    x = np.array([np.append(plain_hashed(t, 64).astype("<f2"), 1) for t in often])
    y, n = np.array([known[tuple(plain_votes(t))] for t in often]), np.array([min(8, c) for c in often.values()])
    w = np.zeros(65)
    before, ahead = w, w
    for k in range(cfg.train_rounds):
        p = [1 / (1 + np.exp(-sum(a * b for a, b in zip(row, ahead, strict=True)))) for row in x]
        grad = sum(row * (a - b) * c for row, a, b, c in zip(x, p, y, n, strict=True)) / n.sum() + cfg.decay * ahead
        w = ahead - cfg.rate * grad
        ahead, before = w + k / (k + 3) * (w - before), w
    for i, t in rows:
        score = 1 / (1 + np.exp(-(plain_hashed(t or "", 64) @ w[:-1] + w[-1])))
        assert abs(got[i].score - score) < 2e-3 and abs(got[i].weak_label - known[tuple(plain_votes(t or ""))]) < 1e-9
        assert got[i].kept == ((got[i].score + got[i].weak_label) / 2 >= cfg.threshold)


def test_a_hot_text_leaves_room_for_others_in_the_sample(spark):
    df = documents(spark, [(k, "same text " * 30) for k in range(500)] + [(1000 + k, prose(k, 60)) for k in range(40)])
    low = df.selectExpr("xxhash64(text) as h").distinct().orderBy("h").limit(20).count()
    assert low == 20
    whole = weaklabel.classify(df, weaklabel.WeakLabelConfig(sample=41))
    part = weaklabel.classify(df, weaklabel.WeakLabelConfig(sample=41, most_weight=1))
    score = lambda d: d.where("doc_id = 0").first().score
    # The hot text is one of 41 distinct ones, with a weight of 8 at most.
    assert abs(score(whole) - score(part)) < 0.5 and whole.count() == 540


def test_em_recovers_accuracies():
    r = np.random.default_rng(8)
    truth = r.random(20_000) < 0.85
    acc = [(0.97, 0.8), (0.95, 0.6), (0.9, 0.7), (0.98, 0.5)]
    v = np.stack([np.where(truth, np.where(r.random(len(truth)) < g, 1, -1), np.where(r.random(len(truth)) < b, -1, 1)) for g, b in acc], axis=1).astype(np.int8)
    v[r.random(v.shape) < 0.2] = 0
    kinds, back, n = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    post, est, good = weaklabel.fit_labellers(kinds, n.astype(float), 200)
    assert abs(good - 0.85) < 0.04 and np.abs(est[0] - [a for a, _ in acc]).max() < 0.05
    assert ((post[back] > 0.5) == truth).mean() > 0.9
