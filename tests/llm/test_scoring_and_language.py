import numpy as np
import pytest
from pyspark.sql import functions as F

from behavior_spark.llm import language_id as G
from behavior_spark.llm import lm_scoring as P
from tests.llm.helpers import awkward, frame

SMALL = P.Window(classes=8, per_class=8, buckets=8, width=6, batch=512)


def test_gradient_is_the_slope():
    conf = P.Window(classes=3, per_class=4, buckets=2, width=5, radius=1, rate=1e-3, seed=1)
    rng = np.random.default_rng(0)
    token, around = rng.integers(0, 12, 40), rng.integers(0, 13, (40, 2))
    net = P.Net(conf, P.Net(conf).flat.astype(np.float64))
    before, seen = net.flat.copy(), P.Net(conf, np.zeros_like(net.flat))
    net.step(token, around, seen)
    slope = np.sqrt(seen.flat)
    for i in rng.choice(len(before), 60, replace=False):
        up, down = before.copy(), before.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        numeric = -(P.Net(conf, up).log_probs(token, around).mean() - P.Net(conf, down).log_probs(token, around).mean()) / 2e-5
        assert abs(abs(numeric) - slope[i]) < 1e-6
        assert numeric * (before[i] - net.flat[i]) >= -1e-12


def test_probabilities_add_up_to_one():
    net = P.Net(SMALL)
    net.start(np.arange(64.0))
    around = np.tile(np.array([[1, 2, 64, 5]]), (64, 1))
    assert abs(np.exp(net.log_probs(np.arange(64), around)).sum() - 1) < 1e-4


def test_windows_hide_the_token_and_stop_at_documents():
    token, around = P.windows([np.array([1, 2, 3]), np.array([], int), np.array([4])], P.Window(radius=2))
    pad = P.Window().tokens
    assert token.tolist() == [1, 2, 3, 4]
    assert around.tolist() == [[pad, pad, 2, 3], [pad, 1, 3, pad], [1, 2, pad, pad], [pad] * 4]


def test_net_beats_frequencies_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    conf = P.Window()
    known, held_out = docs.where("doc_id % 5 != 0"), docs.where("doc_id % 5 = 0")
    ids, totals, _ = P.vocabulary(known, conf)
    net = P.Net(conf, P.train(P.numbered(known, ids, conf), totals, conf))
    rows = [np.frombuffer(r.tokens, "<u2") for r in P.numbered(held_out, ids, conf).collect()]
    token, around = P.windows(rows, conf)
    frequency = np.log((totals + 0.5) / (totals + 0.5).sum())[token].mean()
    assert net.log_probs(token, around).mean() > frequency + 0.2
    shuffled = np.random.default_rng(0).permutation(token)
    assert net.log_probs(shuffled, around).mean() < net.log_probs(token, around).mean() - 0.2


def test_scores_of_awkward_rows(spark):
    got = P.score(frame(spark), SMALL).collect()
    assert len(got) == len(awkward())
    words = sorted(len((t or "").encode().split()) for _, t, *_ in awkward())
    assert sorted(r.n_words for r in got) == words
    assert all((r.log_likelihood < 0) == (r.n_words > 0) and (r.mean_log_prob is None) == (r.n_words == 0) for r in got)
    assert sorted(map(str, got)) == sorted(map(str, P.score(frame(spark), SMALL).collect()))
    assert P.score(frame(spark, []), SMALL).count() == 0


@pytest.fixture(scope="module")
def judged(spark):
    docs, pages = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "pages"))
    model = G.train(docs.where("doc_id % 2 = 0"))
    return docs, pages, G.fused(G.rows_of(pages, docs), model).cache()


def test_language_of_held_out_documents(judged):
    docs, pages, got = judged
    assert got.count() == docs.count() + pages.count()
    rows = got.where("kind = 'document'").join(docs.select(F.col("doc_id").alias("id"), "lang"), "id").where("id % 2 = 1").collect()
    assert sum(r.language == r.lang for r in rows) >= 0.97 * len(rows)
    assert all(0 < r.confidence <= 1 for r in rows)


def test_declared_language_decides_where_the_text_does_not(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    more = spark.createDataFrame([(90001, "https://nowhere.example.org/x", "<html lang='de'></html>"), (90002, None, None), (90003, "not an address", ""),
                                  (90004, "https://nowhere.example.org/x", "<html lang='zz'>")], "page_id long, url string, html string")
    got = {r.id: r for r in G.fused(G.rows_of(pages.unionByName(more), None), G.train(docs)).collect()}
    assert got[90001].language == "de" and got[90001].declared == "de"
    assert got[90002].language is not None and got[90002].host is None
    assert {90003, 90004} <= set(got)


def test_hosts_are_smoothed_towards_their_domain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = G.train(docs)
    french = docs.where("lang = 'fr'").limit(30).collect()
    rows = [(i, "https://www.fr-site.example/a", f"<html>{r.text}</html>") for i, r in enumerate(french)]
    rows += [(i + 1000, f"https://h{i}.other.test/", f"<html>{r.text}</html>") for i, r in enumerate(docs.where("lang = 'en'").limit(60).collect())]
    rows += [(5000, "https://new.fr-site.example/b", "<html></html>"), (5001, "https://www.fr-site.example/c", "<html></html>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.id: r.language for r in G.fused(G.rows_of(pages, None), model).collect()}
    assert got[5001] == "fr"


def test_fusion_equals_loops(spark):
    """Every count, prior and posterior again, row by row."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    model = G.train(docs)
    rows = [r.asDict() for r in G.described(G.rows_of(pages, docs), model).collect()]
    n, kappa = len(model.languages), model.conf.kappa

    def soft(x):
        e = np.exp(x - np.max(x))
        return e / e.sum()

    for r in rows:
        r["p"] = soft(np.array(r["text_evidence"]))
    whole = sum(r["p"] for r in rows)
    size = max(whole.sum(), 1.0)

    def group(*names):
        sums = {}
        for r in rows:
            key = tuple(r[x] for x in names)
            sums[key] = sums.get(key, 0) + r["p"]
        return [np.maximum(sums[tuple(r[x] for x in names)] - r["p"], 0) for r in rows]

    declared, suffix, domain, host = group("declared"), group("suffix"), group("suffix", "domain"), group("domain", "host")
    want = {}
    for i, r in enumerate(rows):
        prior = (whole + 1) / (size + n)
        prior = (domain[i] + kappa * prior) / (domain[i].sum() + kappa)
        prior = (host[i] + kappa * prior) / (host[i].sum() + kappa)
        evidence = np.array(r["text_evidence"]) + np.log(prior)
        for name, own in (("declared", declared[i]), ("suffix", suffix[i])):
            if r[name] is not None:
                evidence += np.log((own + kappa * (own.sum() + 1) / (size + 1)) / (whole + kappa))
        posterior = soft(evidence)
        want[r["kind"], r["id"]] = model.languages[int(posterior.argmax())], posterior.max()
    got = G.fused(G.rows_of(pages, docs), model).collect()
    assert len(got) == len(want) == len(rows)
    for r in got:
        language, confidence = want[r.kind, r.id]
        assert r.language == language and abs(r.confidence - confidence) < 1e-9


def test_every_label_is_learnt_from_whole_texts(spark):
    rows = [(i, f"{chr(97 + i % 26)}{i} " * 40, f"l{i}") for i in range(250)]
    rows += [(1000, "x " * 4000 + "zebra " * 400, "tail"), *[(2000 + i, "the same text", "hot") for i in range(400)]]
    model = G.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), G.Fusion(per_language=100))
    assert len(model.languages) == 252
    best = max(zip(model.evidence(b"zebra zebra zebra zebra"), model.languages, strict=True))
    assert best[1] == "tail"


def test_no_labels_and_no_rows(spark):
    docs = frame(spark, [])
    assert G.fused(G.rows_of(None, docs), G.train(docs)).count() == 0
    rows = G.fused(G.rows_of(None, frame(spark)), G.train(docs)).collect()
    assert len(rows) == len(awkward()) and all(r.language is None for r in rows)


def test_markup_is_not_text():
    page = b"<html lang=en><head><script>var a='</p>';</script><style>p{}</style></head><!-- no --><p>One &amp; two</p></html>"
    assert G.visible(page).split() == [b"One", b"&", b"two"]
