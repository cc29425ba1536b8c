"""Each operator against brute force on the smallest tables, and on edge rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vellum.llm import common, components, decontamination, fingerprints, katz, language, mixing, pages, pii, registry, simhash, similar, tokenfiles, toxicity

LONG = "wort " * 30_000
EDGE = [(None, None, None, None), (1, "", "de", "a"), (2, None, "en", None), (3, "One two three four five six seven", "en", "a"), (3, "One two three four five six seven", "en", "a"), (4, LONG, "de", "b"), (5, "12 :: 34", None, "b"), (6, " \t\n ", "fr", "é")]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return common.table(spark, sf, "documents")


@pytest.fixture(scope="module")
def rows(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, a repeated row, further columns with names that operators use inside."""
    df = spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string")
    return df.withColumns({"n_chars": F.length("text").cast("long"), "key": F.lit(1), "fp": F.lit("x"), "row_hash": F.lit(0), "score": F.lit(None).cast("double")})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


# 1
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(x - 9 * (x > 9) for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits)))) % 10 == 0


def confirmed(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in match.split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def test_pii(spark, rows):
    more = ["a@b.c@d.e", "a@b.c_x@d.e", " x@y.z.w..q é😀 1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1111-", "+1 (2) 3.4-5 67890+49 30 123456789", "1 " * 5000, "1" * 20000, None, "", "@@@@", "+1" * 500]
    texts = list(rows.items()) + [(10**6 + i, t) for i, t in enumerate(more)]
    got = {r.doc_id: r.base for r in pii.find(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, text in texts:
        want = sorted((m.start(), k, m.end(), name) for k, (name, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if confirmed(name, m.group()))
        assert [(x.start, x.order, x.end, x.kind) for x in got[i]] == want


def test_pii_added(spark):
    text = "DE89 3704 0044 0532 0130 00 THE END GB82WEST12345698765432 DE00370400440532013000 ssn 123-45-6789 call 555-123-4567, id 555-123-4567890"
    r = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [text[x.start : x.end] for x in r.added] == ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "123-45-6789", "555-123-4567"]
    out = pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().redacted
    assert out.startswith("[IBAN] THE END [IBAN] DE00") and "[SSN]" in out


def test_pii_query_digests(spark, tmp_path):
    """The query's counts, digest and spans against the expressions of its contract."""
    texts = [(1, "mail a@b.co or a@b.c@d.e, host 10.0.0.1 and 300.1.1.1"), (2, "card 4111 1111 1111 1111, call +1 (212) 555-0100"), (3, None), (4, "é😀 x@y.z ssn 123-45-6789"), (4, "é😀 x@y.z ssn 123-45-6789")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in pii.op1_pii(spark, str(tmp_path)).collect():
        text = dict(texts)[r.doc_id] or ""
        want = sorted((m.start(), k, m.end(), name) for k, (name, p) in enumerate(BASE.items()) for m in re.finditer(p, text) if confirmed(name, m.group()))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[3] == k for w in want) for k in BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in want).encode()).hexdigest()
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert [x for x in spans if x[0] in BASE] == [[k, str(a), str(b)] for a, _, b, k in want]
        assert len(spans) == len([x for x in r.scores.split(",") if x])
    lowered = pii.find(spark.createDataFrame([(1, "ssn 123-45-6789"), (2, "isbn or serial 123-45-6789")], "doc_id long, text string")).collect()
    assert [len(r.added) for r in lowered] == [1, 0]


# 2
def test_language(spark, docs):
    got = registry.queries()["op2_language"](spark, "/root/testdata/sf0.01")
    truth = common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang")
    assert got.join(truth, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_expectations_sum_all_segmentations():
    """Expected piece counts of forward-backward against the listing of all segmentations."""
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "▁ab", "bab"]
    p = np.vstack([np.random.default_rng(2).random((len(pieces), 1)), np.full((1, 1), 1e-7), np.zeros((1, 1))])

    def listed(word):
        if not word:
            yield []
        for k in range(1, len(word) + 1):
            if word[:k] in pieces or k == 1:
                for rest in listed(word[k:]):
                    yield [pieces.index(word[:k]) if word[:k] in pieces else len(pieces), *rest]

    for word, count in (("▁abab", 3.0), ("▁bab", 1.0), ("▁acab", 2.0)):
        every = [(np.prod(p[s, 0]), s) for s in listed(word)]
        want = np.zeros(len(p))
        for mass, s in every:
            np.add.at(want, s, count * mass / sum(m for m, _ in every))
        assert np.allclose(language.expected(language.Lattice(pieces).arcs([word]), p, np.array([[count]]))[:-1, 0], want[:-1])


def test_letters_only(spark):
    assert language.words_of("ab² ½ Ⅷ x1y é") == ["ab", "x", "y", "é"]
    docs = spark.createDataFrame([(i, "der die das und", "de") for i in range(9)] + [(9 + i, "the of and to", "en") for i in range(9)], "doc_id long, text string, lang string")
    got = language.predict(spark.createDataFrame([(1, "²"), (2, "und das"), (3, None), (4, "the und"), (4, "the und")], "doc_id long, text string"), language.train(docs)).collect()
    assert [r.lang_pred for r in got][:3] == ["und", "de", "und"] and got[3] == got[4] and got[0].score == got[2].score == 0


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "▁ab", "bab"]
    p = np.vstack([np.random.default_rng(1).random((len(pieces), 2)), np.full((1, 2), 1e-7), np.zeros((1, 2))])
    scorer = language.Scorer(language.Model(("x", "y"), tuple(pieces), p))

    def brute(word):
        if not word:
            return np.ones(2)
        total = np.zeros(2)
        for k in range(1, len(word) + 1):
            head = word[:k]
            if head in pieces or k == 1:
                total = total + (p[pieces.index(head)] if head in pieces else p[len(pieces)]) * brute(word[k:])
        return total

    for word in ("abab", "bab", "c", "acab"):
        assert np.allclose(scorer.score([word])[0][0], np.log(brute("▁" + word)))


# 3
def test_katz(spark, docs, rows):
    wanted = brute_katz(rows)
    for vocabulary in (200_000, 300):
        got = {r.doc_id: r for r in katz.score(docs, katz.fold("doc_id", 7) == 2, vocabulary).collect()}
        for i, want in wanted.items():
            r = got[i]
            assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
            assert math.isclose(r.base_score, want[3], rel_tol=1e-9) and math.isclose(r.score, want[4], rel_tol=1e-6)


def brute_katz(rows):
    tokens = {i: (t or "").encode().lower().split() for i, t in rows.items()}
    train = [i for i in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for i in train for w in tokens[i])
    documents, total, distinct = len(train), sum(c.values()) + len(train), len(c) + 1
    first = {**c, "END": documents, "UNSEEN": 0}
    p1 = {w: (n + 1) / (total + distinct + 1) for w, n in first.items()}
    line = lambda i: ["START", *tokens[i], "END"]
    pairs = {}
    for i in train:
        for h, w in zip(line(i), line(i)[1:], strict=False):
            pairs.setdefault(h, Counter())[w] += 1
    counts = Counter(n for x in pairs.values() for n in x.values())
    d = katz.discounts([counts[r] for r in range(katz.CUTOFF + 2)])
    model = {}
    for h, x in pairs.items():
        n, low = sum(x.values()), sum((1 - d[k]) * k for k in x.values() if k <= katz.CUTOFF)
        seen = {w: ((k - 0.5) if low <= 0 else d[k] * k if k <= katz.CUTOFF else k) / n for w, k in x.items()}
        a = (low if low > 0 else 0.5 * len(x)) / n / (1 - sum(p1[w] for w in x))
        if len(model) % 100 == 0:
            assert math.isclose(sum(seen.get(w, a * p1[w]) for w in p1), 1, rel_tol=1e-9)
        model[h] = (seen, a)
    out = {}
    for i in rows:
        log = 0
        for h, w in zip(line(i), line(i)[1:], strict=False):
            p = p1.get(w, p1["UNSEEN"])
            log += math.log10(model[h][0].get(w, model[h][1] * p) if h in model else p)
        base = sum(math.log10((n + 1) / (total + distinct + 1)) for n in [*[c[w] for w in tokens[i]], documents])
        out[i] = (len(tokens[i]) + 1, sum(c[w] > 0 for w in tokens[i]) + 1, total, base, log)
    return out


# 4
def test_pages():
    page = """<html><head><title>no</title></head><body><header><h1>Site</h1></header><nav><a href=x>menu</a></nav><div id=sidebar><p>links</p></div>
    <div class='content'><h2>Title</h2><p>Hello &amp; bye. This is a long   paragraph.</p><p>More text<br>ok</p></div><section class='comments'><p>Liked it very very much, longer than all.</p></section>
    <script>var x = "</p>";</script><footer>x</footer></body></html>"""
    assert pages.extract(page) == "Title\nHello & bye. This is a long paragraph.\nMore text ok"
    assert pages.extract(None) == pages.extract("") == pages.extract("<script>x") == ""
    assert pages.extract("<p>one<p><b>two") == "one\ntwo" and pages.extract("plain < text") == "plain < text"


def test_pages_on_table(spark, sf):
    got = pages.op4_html(spark, sf)
    html = {r.page_id: r.html for r in common.table(spark, sf, "pages").collect()}
    for r in got.collect():
        article = re.search("<article>(.*)</article>", html[r.page_id] or "", re.S)
        lines = [" ".join(__import__("html").unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", article[1])] if article else []
        assert r.text == "\n".join(x for x in lines if x) and r.n_chars == len(r.text)


# 5
def test_targets(spark):
    def water(sizes, weights=mixing.WEIGHTS):
        total, targets, free = 1.5 * sum(sizes), [0.0] * len(sizes), list(range(len(sizes)))
        w = [weights[i % 3] for i in range(len(sizes))]
        while free:
            left = total - sum(targets[i] for i in range(len(sizes)) if i not in free)
            over = [i for i in free if left * w[i] / sum(w[j] for j in free) > 2 * sizes[i]]
            if not over:
                for i in free:
                    targets[i] = left * w[i] / sum(w[j] for j in free)
                break
            for i in over:
                targets[i] = 2.0 * sizes[i]
                free.remove(i)
        return targets

    for sizes in ([100, 100, 100, 10], [5, 1000, 7, 7, 9], [0, 3, 0], [1]):
        df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
        got = {r.source: r.target for r in mixing.allocate(df).collect()}
        assert np.allclose([got[f"s{i}"] for i in range(len(sizes))], water(sizes))


def test_mix(spark, docs):
    got = mixing.op5_mixing(spark, "/root/testdata/sf0.01")
    again = mixing.op5_mixing(spark, "/root/testdata/sf0.01")
    assert sorted(got.collect()) == sorted(again.collect())
    assert got.where("taken > 2 * size").count() == 0
    off = got.groupBy("source_size", "target").agg(F.sum("taken").alias("t"), F.max("size").alias("most")).where("abs(t - target) > most")
    assert off.count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() > docs.count() * 0.9


def test_pareto_inclusion(spark):
    """Probabilities against brute force, and how often documents are taken over many seeds."""
    sizes = {("a", i): 1 + 7 * i * i % 400 for i in range(120)} | {("b", i): 50 for i in range(40)} | {("c", 0): 9}
    df = spark.createDataFrame([(i, s, n, 10 * i) for (s, i), n in sizes.items()], "doc_id long, source string, size long, row_hash long").cache()
    got = {(r.source, r.doc_id): r for r in mixing.probabilities(mixing.classed(df), mixing.WEIGHTS, mixing.SHARE, mixing.MOST).collect()}
    for s in "abc":
        ids = [k for k in sizes if k[0] == s]
        rest = got[ids[0]]._rest
        w = {k: 2 ** (math.floor(math.log2(math.sqrt(sizes[k])) * mixing.CLASSES) / mixing.CLASSES) for k in ids}
        low, high = 0.0, 1e6
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(sizes[k] * min(1, mid * w[k]) for k in ids) < rest else (low, mid)
        want = {k: min(1, high * w[k]) if got[k]._f > 0 else 0.0 for k in ids}
        assert all(math.isclose(got[k]._p, want[k], rel_tol=1e-6, abs_tol=1e-9) for k in ids)
    assert len({round(r._p, 3) for r in got.values()}) > 10
    trials, taken = 25, Counter()
    for seed in range(trials):
        rows = mixing.mix(df, seed=seed).collect()
        for s in "ab":
            assert abs(sum(r.taken for r in rows if r.source == s) - got[(s, 0)].target) <= 201
        taken.update((r.source, r.doc_id) for r in rows if r.copies > r._whole)
    # groups of like probability are taken as often as it says
    free = sorted((r._p, k) for k, r in got.items() if 0 < r._p < 1)
    for at in range(0, len(free), 40):
        some = free[at : at + 40]
        p, n = sum(x for x, _ in some) / len(some), len(some) * trials
        assert abs(sum(taken[k] for _, k in some) / n - p) < 4 * math.sqrt(p * (1 - p) / n) + 0.02
    assert all(taken[k] == trials for k, r in got.items() if r._p >= 1)


def test_mix_against_brute_force(spark, docs):
    rows = {r.doc_id: r for r in mixing.mix(mixing.sized(docs)).collect()}
    for s in {r.source for r in rows.values()}:
        ids = [i for i, r in rows.items() if r.source == s]
        left, running, extra = rows[ids[0]]._rest, 0, set()
        if rows[ids[0]]._f > 0:
            sure = {i for i in ids if rows[i]._p >= 1}
            left -= sum(rows[i].size for i in sure)
            for i in sorted(set(ids) - sure, key=lambda i: (rows[i]._u / (1 - rows[i]._u) * (1 - rows[i]._p) / rows[i]._p, i)):
                if running + rows[i].size / 2 <= left:
                    extra.add(i)
                running += rows[i].size
            extra |= sure
        assert {i for i in ids if rows[i].copies > rows[i]._whole} == extra


# 6
def test_toxicity(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, d, "documents"), common.table(spark, d, "labels")
    chain = toxicity.train(docs, labels.where("doc_id % 3 <> 0"))
    held = toxicity.score(docs, chain).join(labels.where("doc_id % 3 = 0"), "doc_id").withColumn("t", F.col("p_toxic") >= toxicity.THRESHOLD)
    r = held.selectExpr("sum(int(t and toxic = 1)) tp", "sum(int(t and toxic = 0)) fp", "sum(toxic) p").first()
    assert r.tp / r.p > 0.85 and r.tp / (r.tp + r.fp) > 0.9


def test_chain_against_brute_force(spark):
    """Two linked categories on a tiny table: out-of-fold probabilities and models by Newton's method."""
    rng = np.random.default_rng(3)
    words = ["alpha", "beta", "gamma", "delta"]
    data = []
    for i in range(240):
        has = rng.random(4) < 0.5
        bad = int(rng.random() < 0.15 + 0.6 * has[0])
        data.append((i, " ".join(w for w, h in zip(words, has, strict=True) if h), 1 - bad, int(rng.random() < 0.1 + 0.5 * has[1] + 0.3 * bad)))
    df = spark.createDataFrame(data, "doc_id long, text string, quality int, toxic int")
    chain = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "quality", "toxic"))
    fold = {r[0]: r[1] for r in df.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(toxicity.FOLDS))).collect()}
    x = np.zeros((len(data), len(chain.index)))
    for i, r in enumerate(data):
        for f in {f for w in r[1].split() for f in toxicity.features_of(w)} & set(chain.index):
            x[i, chain.index[f]] = 1
    y = np.array([[1 - r[2], r[3]] for r in data], float)

    def fit(x, y):
        z, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
        ridge = np.diag([toxicity.REGULARISATION] * x.shape[1] + [1e-12])
        for _ in range(60):
            p = 1 / (1 + np.exp(-z @ w))
            w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) / len(z) + ridge, z.T @ (p - y) / len(z) + ridge @ w)
        return lambda a: 1 / (1 + np.exp(-np.hstack([a, np.ones((len(a), 1))]) @ w))

    folds = np.array([fold[r[0]] for r in data])
    out = np.zeros(len(data))
    for k in range(toxicity.FOLDS):
        out[folds == k] = fit(x[folds != k], y[folds != k, 0])(x[folds == k])
    first = fit(x, y[:, 0])(x)
    second = fit(np.hstack([x, out[:, None]]), y[:, 1])(np.hstack([x, first[:, None]]))
    got = {r.doc_id: r for r in toxicity.score(df, chain).collect()}
    assert max(abs(got[r[0]].p_low_quality - first[i]) for i, r in enumerate(data)) < 0.01
    assert max(abs(got[r[0]].p_toxic - second[i]) for i, r in enumerate(data)) < 0.01


def test_toxicity_without_labels(spark, edge):
    chain = toxicity.train(edge, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.keep_clean(edge, chain).count() == len(EDGE)


# 7
@pytest.mark.parametrize("hot", [2048, 2])
def test_simhash(spark, docs, rows, hot):
    ids = list(rows)
    fps = np.array([simhash.fingerprint_of((rows[i] or "").encode()) for i in ids], np.int64).view(np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    root = list(range(len(ids)))
    for _ in range(len(ids)):
        new = [min(root[j] for j in np.flatnonzero(near[i])) for i in range(len(ids))]
        if new == root:
            break
        root = new
    least = {}
    for i, r in enumerate(root):
        least[r] = min(least.get(r, 1 << 60), ids[i])
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, hot_bucket=hot).collect()}
    assert got == {ids[i]: least[r] for i, r in enumerate(root)}


def test_simhash_broadcasts_no_exploded_rows(spark):
    """Probes and points are many rows for each fingerprint, which Spark doesn't know: none may become a table of the driver."""
    fps = common.materialize(spark.range(3000).select(F.xxhash64("id").alias("fp")), "fps")
    for df in (simhash.links(fps), simhash._meeting(fps.limit(100), 4)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
        ran = df.observe("ran", F.count("*").alias("n"))
        ran.collect()
        assert "Broadcast" not in ran._jdf.queryExecution().executedPlan().toString()
    # only the counted values of large groups
    hot = simhash.links(fps, hot_bucket=0)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join Inner.*rightHint=\(strategy=broadcast\)", hot) and hot.count("strategy=merge") >= 3


def test_simhash_bits():
    import xxhash

    words = "A b c d e".lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(2)]
    want = sum(1 << b for b in range(64) if sum((h >> b) & 1 for h in hashes) * 2 > 2)
    assert simhash.fingerprint_of(b"A b c d e") & (1 << 64) - 1 == want and simhash.fingerprint_of(None) == 0


def test_thresholds_hold_the_pigeonhole(spark):
    sample = np.random.default_rng(3).integers(-(1 << 63), 1 << 63, 500)
    for n in (1_000, 10**6, 10**10):
        probe = simhash.plan_probe(sample, n)
        assert sum(probe.thresholds) == 4 - len(probe.masks) + 1
        assert sum(m.bit_count() if m >= 0 else (m & (1 << 64) - 1).bit_count() for m in probe.masks) == 64


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 300), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and got[300] == 100 and 7 in got


# 8
def test_fingerprints(spark, sf, rows):
    ids = sorted(rows)
    got = {r.doc_id: r for r in fingerprints.op8_fingerprints(spark, sf).collect()}
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    errors = []
    for i, after in zip(ids, ids[1:] + ids[:1], strict=True):
        text, other = rows[i] or "", rows[after] or ""
        edited = text[: len(text) - len(text) // 4] + other[: len(text) // 4]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b = shingles(text), shingles(edited)
        errors.append(abs(len(a & b) / len(a | b) - r.near_edited))
        sketch = fingerprints.decoded(r.fingerprint)
        assert abs(fingerprints.distinct_shingles(sketch) - len(a)) <= max(0.5 * len(a), 0 if len(a) > fingerprints.K else 0)
    assert np.mean(errors) < 0.03 and max(errors) < 0.2


def test_sketches_merge(spark, docs):
    sketches = fingerprints.sketch_documents(docs).withColumn("all", F.lit(1))
    merged = fingerprints.merge_sketches(sketches, "all").first().fingerprint
    whole = fingerprints.merge(*[fingerprints.decoded(r.fingerprint) for r in sketches.collect()])
    assert fingerprints.encoded(whole) == merged
    a, b = fingerprints.decoded(sketches.first().fingerprint), whole
    assert 0 <= fingerprints.containment(a, b) <= 1 and fingerprints.resemblance(a, a) == 1


# 9
def test_token_files(spark, docs, rows):
    from tokenizers import Tokenizer

    odd = {10**6 + i: t for i, t in enumerate(["", "  ", " a", "a ", "a  b", "x \ny z", "x\n \ny", "<|endoftext|> a <|endoftext|>b", "\ta b\t c", "don't it's 12 34", "a\n\nb", "\r\na b", None, "é  ü"])}
    texts = {**rows, **odd}
    path = common.new_path(spark, "test-tokens")
    got = tokenfiles.encode_and_read(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), path)
    tokenizer, start = Tokenizer.from_file(tokenfiles.public_tokenizers.path(tokenfiles.VOCABULARY)), 0
    for r in got.orderBy("doc_id").collect():
        ids = np.array([*tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert tokenfiles.read_tokens(spark, path).where("doc_id = 10").first().ids[-1] == 0


def test_encoder_forgets(rows, monkeypatch):
    monkeypatch.setattr(tokenfiles, "CACHE_PIECES", 500)
    encoder = tokenfiles.PieceEncoder(tokenfiles.public_tokenizers.path(tokenfiles.VOCABULARY))
    texts = [t or "" for t in rows.values()]
    for at in range(0, len(texts), 10):
        ids, ends = encoder.encode(texts[at : at + 10], 0)
        for text, got in zip(texts[at : at + 10], np.split(ids, ends[:-1]), strict=True):
            assert got.tolist() == [*encoder.whole(text), 0]


def test_encoder_looks_a_piece_up_once_a_call(monkeypatch):
    """However often a piece stands in the texts of a call; the ids are the tokenizer's."""
    looked = []

    class Counted(tokenfiles._Numbers):
        def __getitem__(self, key):
            looked.append(key)
            return super().__getitem__(key)

    monkeypatch.setattr(tokenfiles, "_Numbers", Counted)
    encoder = tokenfiles.PieceEncoder(tokenfiles.public_tokenizers.path(tokenfiles.VOCABULARY))
    texts = ["ein Haus und ein Haus\nund ein Hof\n\nein Haus"] * 40 + ["", " ein", "\nein Hof", "Haus  Hof", "Haus \nHof", "ein ", "\t ein"]
    ids, ends = encoder.encode(texts, 0)
    for text, got in zip(texts, np.split(ids, ends[:-1]), strict=True):
        assert got.tolist() == [*encoder.whole(text), 0]
    distinct = {x for t in texts for x in t.replace("\n", " \n").split(" ")}
    assert len(looked) <= len(distinct) + len(texts)


# 10
def test_decontamination(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(decontamination.ORACLE_SQL["op10_decontamination"]).fetchall()
    got = [tuple(r) for r in decontamination.op10_decontamination(spark, sf).collect()]
    assert sorted(got) == sorted(want) and any(r[5] for r in got)


def test_proximity(spark):
    d = spark.createDataFrame([(1, "a b x c d"), (2, "a b c"), (3, "c b a"), (4, None), (5, "a " * 50 + "b c")], "doc_id long, text string")
    phrase = spark.createDataFrame([(1, "A b c")], "item_id long, text string")
    near = lambda span: sorted((r.doc_id, r.end) for r in decontamination.find_near(d, phrase, span).collect())
    assert near(2) == [] and near(3) == [(2, 3), (3, 3), (5, 52)] and near(4) == [(1, 4), (2, 3), (3, 3), (5, 52)]
    long = spark.createDataFrame([(1, "a b c " + "d e f g h i j k l " * 3)], "item_id long, text string")
    assert decontamination.find_near(d, long).count() == 0


def test_repeated_words_do_not_multiply(spark, tmp_path):
    d = [(1, "wort " * 30_000), (2, "x " + "a b " * 3_000 + "y"), (3, "wort " * 9), (4, "wort " * 12 + "z " + "wort " * 10), (5, "one two three")]
    b = [(1, "wort " * 5_000), (2, "a b " * 2_000), (3, "b a " * 8), (4, "Three"), (5, "wort wort")]
    docs, items = spark.createDataFrame(d, "doc_id long, text string"), spark.createDataFrame(b, "item_id long, text string")
    docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    items.toPandas().to_parquet(tmp_path / "benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    want = con.execute(decontamination.ORACLE_SQL["op10_decontamination"]).fetchall()
    got = sorted(tuple(r) for r in decontamination.contamination(docs, items).collect())
    assert got == sorted(want) and [r[2] for r in got] == [30_000, 6_000, 9, 22, 1]


def test_short_items_and_overlaps(spark):
    d = spark.createDataFrame([(1, "x Foo bar foo BAR y"), (1, "x Foo bar foo BAR y"), (2, "nothing")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "foo, bar"), (8, "foo bar"), (9, ""), (10, None)], "item_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in decontamination.contamination(d, b).collect())
    assert got == [(1, 6, 4, 2), (1, 6, 4, 2), (2, 1, 0, 0)]
    assert decontamination.contamination(d, b.limit(0)).where("contaminated").count() == 0


# all
APPLIED = {
    "pii": lambda df: pii.find(df),
    "language": lambda df: language.predict(df, language.train(df)),
    "katz": lambda df: katz.score(df, katz.fold("doc_id", 7) == 2),
    "mixing": lambda df: mixing.mix(mixing.sized(df)),
    "simhash": lambda df: simhash.near_duplicates(df),
    "fingerprints": lambda df: fingerprints.edited_neighbours(df),
    "tokens": lambda df: tokenfiles.encode_and_read(df),
    "decontamination": lambda df: decontamination.contamination(df, df.select(F.col("doc_id").alias("item_id"), "text")),
    "toxicity": lambda df: toxicity.score(df, toxicity.train(df, df.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic")))),
}


@pytest.mark.parametrize("name", APPLIED)
def test_edges(edge, name):
    assert APPLIED[name](edge).count() == len(EDGE)


@pytest.mark.parametrize("name", APPLIED)
def test_empty(nothing, name):
    assert APPLIED[name](nothing).count() == 0


def test_pipeline_stages(spark, sf, docs):
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.materialize(stage(spark, kept, sf), name)
        assert after.columns == docs.columns
        if name == "near_duplicates":
            assert sorted(r.doc_id for r in after.collect()) == sorted(set(jaccard_roots({r.doc_id: r.text for r in kept.collect()}).values()))
        if name == "decontamination":
            clean = decontamination.contamination(kept, common.table(spark, sf, "benchmark")).where("not contaminated")
            assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in clean.collect())
        kept = after
    assert corpus_pipeline.STAGES[-1][1](spark, kept, sf).count() == kept.count()


def test_pipeline_stages_on_edges(spark, sf, edge, nothing):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert common.materialize(stage(spark, nothing, sf), name).count() == 0
        after = stage(spark, edge, sf)
        assert after.columns == edge.columns and (name == "mixing" or after.count() == (5 if name == "near_duplicates" else len(EDGE)))
    assert corpus_pipeline.STAGES[-1][1](spark, nothing, sf).count() == 0


@pytest.mark.parametrize("dedup", [simhash.deduplicate, similar.deduplicate])
def test_deduplicate_edges(spark, edge, dedup):
    """No text, no words and blanks are one group whose row without an id stays; of equal rows one stays."""
    kept = dedup(edge)
    assert kept.columns == edge.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(0, None), (1, ""), (3, EDGE[3][1]), (4, LONG), (5, "12 :: 34")])
    a, b = "some words of the text A, long enough", "quite another text, B, that nobody has copied"
    twice = spark.createDataFrame([(1, a), (2, b), (2, a), (3, b)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in dedup(twice).collect()) == [(1, a), (2, b)]


def jaccard_roots(texts):
    """Per id the least one that links of a five-word Jaccard similarity of 0.8 reach."""
    sets = {k: {tuple(w[i : i + 5]) for w in [(t or "").lower().split()] for i in range(max(1, len(w) - 4)) if w} for k, t in texts.items()}
    near = lambda a, b: a == b or (a | b and 5 * len(a & b) >= 4 * len(a | b))
    root = {k: k for k in sets}
    for _ in root:
        new = {k: min(root[j] for j in sets if near(sets[k], sets[j])) for k in sets}
        if new == root:
            break
        root = new
    return root


# near copies of the pipeline
@pytest.mark.parametrize("block", [1000, 2])
def test_near_duplicate_stage_is_exact_jaccard(spark, rows, block):
    base = [f"w{i}" for i in range(300)]
    texts = {k: " ".join(w if i % 97 != k or not k else f"x{k}" for i, w in enumerate(base)) for k in range(0, 40)}
    texts |= {100: "a b c", 101: "A  b\nC", 102: "a b d", 103: "", 104: None, 105: " ", 106: " ".join(base[:245]), 107: " ".join(base[:236])}
    texts |= {1000 + i: t for i, t in list(rows.items())[:60]} | {2000 + i: (t or "") + " one more" for i, t in list(rows.items())[:20]}
    root = jaccard_roots(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = common.materialize(similar.near_copies(df, block), "found")
    groups = {}
    for r in found.collect():
        groups.setdefault(r.root, []).append(r.doc_id)
    assert {i: min(g) for g in groups.values() for i in g} == root
    if block > 2:
        got = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, None).collect())
        assert got == sorted(set(root.values())) and len(simhash.deduplicate(df).collect()) != len(got)


def test_near_duplicate_texts_travel_only_for_near_fingerprints(spark, monkeypatch):
    """Texts that share a passage share bands, but are not sent to each other; those of near copies in such bands are."""
    passage = [f"p{i}" for i in range(60)]
    texts = {k: " ".join(passage + [f"own{k}x{i}" for i in range(60)]) for k in range(40)}
    texts |= {100 + k: texts[k] + f" tail{k}" for k in range(0, 40, 13)}
    stored, materialize = {}, similar.materialize

    def kept(df, name, path=None):
        return stored.setdefault(name, []).append(materialize(df, name, path)) or stored[name][-1]

    monkeypatch.setattr(similar, "materialize", kept)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in similar.deduplicate(df).collect()) == list(range(40))
    assert stored["open"][0].count() >= 40
    assert sum(x.count() for x in stored["ends"]) <= 16


def test_near_duplicate_plans_are_small(spark, monkeypatch):
    """Each join of a plan may be a table that the driver builds, each use of an unstored step repeats its joins."""
    planned, materialize = [], common.materialize

    def kept(df, name, path=None):
        planned.append((name, df._jdf.queryExecution().optimizedPlan().toString().count("Join ")))
        return materialize(df, name, path)

    for module in (similar, components):
        monkeypatch.setattr(module, "materialize", kept)
    passage = [f"p{i}" for i in range(60)]
    texts = {k: " ".join(passage + [f"own{k}x{i}" for i in range(60)]) for k in range(12)} | {100: " ".join(passage + [f"own0x{i}" for i in range(60)] + ["tail"])}
    found = similar.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {"rooted", "open", "sides", "ends", "stars", "links"} <= {n for n, _ in planned}
    assert max(n for _, n in planned) <= 4, planned
    assert {r.doc_id: r.root for r in found.collect()}[100] == {r.doc_id: r.root for r in found.collect()}[0]


def test_near_duplicate_search_meets_all_within_its_limit(spark):
    """Fingerprints share a key wherever the differing symbols stand, spread over all partitions included, whatever the plan."""
    rng = np.random.default_rng(3)
    one = (np.arange(similar.SYMBOLS) << 16) | rng.integers(0, 1 << 16, similar.SYMBOLS)
    samples = [rng.integers(0, 1 << 16, (60, similar.SYMBOLS)), rng.integers(0, 2, (60, similar.SYMBOLS))]
    for found in (similar.plan(samples[0], 100), similar.plan(samples[1], 1_000_000), similar.plan(samples[0][:0], 0)):
        assert sorted(j for part in found.parts for j in part) == list(range(similar.SYMBOLS)) and sum(found.thresholds) == similar.LIMIT - len(found.parts) + 1
        dealt = [p[i] for i in range(max(map(len, found.parts))) for p in found.parts if i < len(p)]
        spread = [[*dealt[i:], *dealt[:i]][: similar.LIMIT] for i in range(0, 60, 7)] + [rng.permutation(similar.SYMBOLS)[: similar.LIMIT].tolist() for _ in range(200)]
        others = [[int(x) ^ (1 if j in gone else 0) for j, x in enumerate(one)] for gone in map(set, spread)]
        df = spark.createDataFrame([(i, one.tolist(), o) for i, o in enumerate(others)] + [(-1, [], [])], "i long, a array<int>, b array<int>")
        met = df.select("i", F.arrays_overlap(similar.keys(F.col("a"), found), similar.keys(F.col("b"), found)).alias("met")).collect()
        assert all(r.met for r in met if r.i >= 0) and not any(r.met for r in met if r.i < 0)


# pages without article or main
def test_densities_are_the_formula(spark, sf):
    """Composite density and sums by recursion over the tree, on real pages."""
    for r in common.table(spark, sf, "pages").limit(40).collect():
        page = pages.parse(r.html or "")
        below = {i: [j for j in range(len(page.parent)) if page.parent[j] == i] for i in range(len(page.parent))}

        def totals(i, page=page, below=below):
            parts = [totals(j, page, below) for j in below[i]]
            return tuple(own + sum(p[k] for p in parts) + (len(parts) if k == 2 else 0) for k, own in enumerate((page.chars[i], page.linked[i], page.tags[i], page.links[i])))

        body, density, sums = totals(0), *pages.densities(page)
        for i in below:
            c, lc, t, lt = totals(i)
            want = 0.0
            if c:
                base = max(math.log(c / max(c - lc, 1) * lc + body[1] / max(body[0], 1) * c + math.e), 1 + 1e-9)
                want = c / max(t, 1) * max(math.log(c / max(lc, 1) * max(t, 1) / max(lt, 1), base) if base > 1 + 1e-9 else math.log(c * max(t, 1)), 0)
            assert math.isclose(density[i], want, rel_tol=1e-6, abs_tol=1e-9)
            assert math.isclose(sums[i], sum(density[j] for j in below[i]), rel_tol=1e-9, abs_tol=1e-9)


def test_pages_of_several_containers():
    p = lambda k: f"<p>Paragraph {k} is a sentence of some length, as {k} texts have it.</p>"
    page = f"<body><h1>A title that is long enough to weigh</h1><div>{p(1)}{p(2)}{p(3)}</div><div>{p(4)}{p(5)}</div><div><a href=x>menu</a><a href=y>more</a></div></body>"
    lines = pages.extract(page).split("\n")
    assert lines == ["A title that is long enough to weigh", *[f"Paragraph {k} is a sentence of some length, as {k} texts have it." for k in range(1, 6)]]
    for article in ("<article>", "<article class='post comments-open'>", "<div class='content share-price'>"):
        close = article[1:8] if article[1] == "a" else "div"
        found = pages.extract(f"<body><div><a href=x>one</a> <a href=y>two</a></div>{article}{''.join(map(p, range(2, 10)))}</{close}><div class='comments'>{p(11)}</div></body>")
        assert found.count("\n") == 7 and "one" not in found and "11" not in found
    assert pages.extract('<div><p title="abc>Hello world text here.</p></div>') == "Hello world text here."
    deep = "<div>" * 3000 + p(1) + "</div>" * 3000
    assert "Paragraph 1" in pages.extract(deep)
