import numpy as np
import pytest

from leafgrid.llm import quality, urls

GOOD = "The house of the old man stood near the river and it was quiet in the evening when they came to see him for a talk about the harvest and the roads. "
BAD = {"caps": "BUY NOW!! CHEAP!! OFFER!! TODAY!! " * 12, "symbols": "word*** other### thing$$$ more&&& " * 12, "repeat": "the the the the the same same same same same same " * 10, "toxic": GOOD + "you stupid worthless idiot you are pathetic trash " + GOOD}


def corpus():
    rng = np.random.default_rng(0)
    words = GOOD.split()
    rows = [" ".join(rng.permutation(words)) + " the end of it." for _ in range(120)]
    rows += [t + " " + w for t in BAD.values() for w in words[:10]]
    return rows


def test_em_finds_the_better_labeller():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.3
    votes = ["".join("j" if (t if rng.random() < a else not t) else "g" for a in (0.95, 0.9, 0.6)) for t in truth]
    patterns, counts = np.unique(votes, return_counts=True)
    share, table, post = quality.em(list(patterns), list(counts))
    assert table[0, 1, 1] > table[2, 1, 1] and abs(share[1] - 0.3) < 0.1
    assert post[list(patterns).index("jjj")][1] > 0.9


def test_one_vote_for_a_fault_makes_no_class():
    share, _, posterior = quality.em(["gg-g-gg-g---ggg", "gg-g-gg-g-j-ggg"], [36, 6])
    assert (posterior[:, 0] > 0.9).all() and share[0] > 0.9


def test_classify(docs):
    rows = corpus()
    got = {r.doc_id: r for r in quality.classify(docs(rows)).collect()}
    assert all(got[k].keep for k in range(120))
    assert not any(got[k].keep for k in range(120, len(rows)))
    assert all(abs(r.p_good + r.p_junk + r.p_toxic - 1) < 1e-9 for r in got.values())


def test_edges(docs, spark):
    rows = [*corpus(), None, "", "   ", (None, GOOD), (5, GOOD), (5, GOOD), (7, GOOD * 8000)]
    got = quality.classify(docs(rows, extra=("keep", "p_good"))).collect()
    assert len(got) == len(rows)
    by = {k: [r for r in got if r.doc_id == k] for k in (5, 7, None)}
    assert [r.keep for r in by[None]] == [True] and len({r.p_good for r in by[5][1:]}) == 1
    assert [r.keep for r in got if r.doc_id in (160, 161, 162)] == [False] * 3
    assert quality.classify(docs([])).count() == 0
    kept = quality.keep_good(docs(rows, extra=("keep",)))
    assert kept.columns[-1] == "keep" and kept.count() == sum(r.keep for r in got)


def test_labels_extend_the_lexicon(docs, spark):
    rng = np.random.default_rng(2)
    words = GOOD.split()
    rows = [" ".join(rng.permutation(words)) + (" zorgly grimpf" if k % 4 == 0 else "") for k in range(80)]
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(60)], "doc_id long, quality int, toxic int")
    found = quality.derive_lexicon(docs(rows), labels)
    assert {"zorgly", "grimpf"} <= found and not found & set(words)
    got = {r.doc_id: r.keep for r in quality.classify(docs(rows), labels).collect()}
    assert not any(got[k] for k in range(0, 80, 4)) and all(got[k] for k in range(80) if k % 4)
    assert quality.derive_lexicon(docs(rows), labels.limit(0)) == frozenset()
    assert quality.derive_lexicon(docs(rows), labels.filter("doc_id < 12")) == frozenset()  # three toxic documents prove nothing
    empty = docs(rows, extra=("toxic",)).limit(0)
    assert quality.keep_good(empty, labels).count() == 0 and quality.keep_good(empty, labels).columns == empty.columns


def test_toxicity_is_a_share(docs):
    passage = GOOD * 30
    ordinary = [passage + "It was a stupid mistake.", GOOD * 6 + "Put the trash out on Monday.", GOOD + "The fishermen set crap traps.", passage + "He called him an idiot and a clown once."]
    toxic = [GOOD + "you idiot and clown", GOOD + "you stupid pathetic trash " + GOOD, "what a worthless loser he is"]
    got = [r.keep for r in quality.classify(docs(corpus() + ordinary + toxic)).orderBy("doc_id").collect()]
    assert got[-len(toxic) - len(ordinary) :] == [True] * len(ordinary) + [False] * len(toxic)


def test_other_scripts_are_not_junk_by_their_words():
    for text in ("Москва является столицей России и крупнейшим городом страны, где живут миллионы людей. " * 8, "東京は日本の首都であり、世界でも有数の大都市である。多くの人が住んでいる。" * 8):
        assert "j" not in quality.votes(quality.features(text))[10:12]


def test_sample_stays_bounded_and_useful(docs):
    rows = [(None, t) for t in corpus()] + [(None, GOOD)] * 300
    got = quality.classify(docs(rows), train_rows=100).collect()
    assert sum(r.keep for r in got) == 420


def test_equal_to_brute_force_of_the_parts(docs, spark):
    """The query's counts, posterior and scores against plain loops over the rows."""
    rows = corpus()
    weights, learned = quality.fit(docs(rows))
    patterns = [quality.votes(quality.features(t)) for t in rows]
    kinds = sorted(set(patterns))
    _, _, post = quality.em(kinds, [patterns.count(p) for p in kinds])
    order = sorted(range(len(rows)), key=lambda k: (patterns[k], quality.hashed(quality.features(rows[k]))[0].tobytes()))
    want = quality.train([quality.hashed(quality.features(rows[k])) for k in order], np.array([post[kinds.index(patterns[k])] for k in order]))
    assert not learned and np.allclose(weights, want, atol=1e-5)
    for r in quality.classify(docs(rows)).collect():
        index, value = quality.hashed(quality.features(rows[r.doc_id]))
        z = [sum(float(v) * float(want[i, c]) for i, v in zip(index, value)) + float(want[-1, c]) for c in range(3)]
        p = np.exp(np.array(z) - max(z))
        assert abs(r.p_good - p[0] / p.sum()) < 1e-4 and r.keep == (r.p_good >= 0.5)


def test_held_out_accuracy(spark, data):
    docs_, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    got = quality.classify(docs_, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), "doc_id").toPandas()
    junk = got[(got.quality == 0)]
    clean = got[(got.quality == 1) & (got.toxic == 0)]
    assert (~junk.keep).mean() > 0.85 and clean.keep.mean() > 0.9


def test_url_model():
    test = [("http://best-casino.win/slots/free-spins", 1), ("https://sexy-webcam.xxx/porn/9", 1), ("https://viagra-cheap.pharmacy/buy-viagra", 1), ("https://www.library.edu/article/77", 0), ("https://blog.example.org/2020/travel", 0), ("http://museum.gov/about", 0)]
    w = urls.train(urls.LABELLED)
    for url, y in test:
        g = urls.grams(url)
        assert (w[g].sum() / len(g) ** 0.5 + w[-1] > 0) == y, url


def test_url_holdout():
    rng = np.random.default_rng(0)
    hosts = {h for y in (0, 1) for h in urls._HOSTS[y]}
    out = set(rng.choice(sorted(hosts), 12, replace=False))
    split = lambda keep: [(u, y) for u, y in urls.LABELLED if (u.split("/")[2] in out) == keep]
    w = urls.train(split(False))
    right = [(w[g].sum() / len(g) ** 0.5 + w[-1] > 0) == y for g, y in ((urls.grams(u), y) for u, y in split(True))]
    assert np.mean(right) > 0.9


def test_unwanted_words_of_a_host_decide(spark, data):
    families = "casino-win free-bets cheap-pills adult-x ads-track spam-farm".split()
    assert not any(f in u for u, _ in urls.LABELLED for f in families)
    hosts = [(f"{p}{f}.example.{s}", False) for f in families for p, s in (("", "org"), ("www.", "com"), ("m.", "net"))] + [(f"blog.{h}.example.net", True) for h in ("ththan", "tionsh", "therin", "garden-letters")]
    rows = [(k, f"https://{h}{p}", keep) for k, (h, keep) in enumerate(hosts) for p in ("/en/728?utm_source=feed", "/fr/25#top", "/de/770/")]
    got = [r.keep for r in urls.score(spark.createDataFrame([(k, u) for k, u, _ in rows], "page_id long, url string")).collect()]
    assert got == [keep for *_, keep in rows]
    pages = spark.read.parquet(f"{data}/pages.parquet")
    for r in urls.score(pages).join(pages.select("page_id", "url"), "page_id").collect():
        assert r.keep != any(f in r.url for f in families), r.url


def test_known_sites():
    w = urls.train(urls.LABELLED)
    p = lambda u: 1 / (1 + np.exp(-(w[urls.grams(u)].sum() / len(urls.grams(u)) ** 0.5 + w[-1])))
    for u in ("https://www.pornhub.com/view_video.php?viewkey=abc123", "https://www.redtube.com/12345678", "https://www.bet365.com/#/HO/", "http://malware-site.tk/download.exe", "https://m.xvideos.com/video.999/title", "https://casino-slots.online/en/bonus"):
        assert p(u) > 0.5, (u, p(u))
    for u in ("https://en.wikipedia.org/wiki/Gambling", "https://www.youtube.com/watch?v=abc", "https://github.com/apache/spark", "https://www.bbc.co.uk/news/world-1234", "https://docs.python.org/3/library/re.html"):
        assert p(u) < 0.5, (u, p(u))


def test_url_scores_against_plain_loops(spark, data):
    """The query against a reading of the definition, one n-gram after the other."""
    import re
    import zlib

    w = urls.train(urls.LABELLED)
    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = {r.page_id: r for r in urls.op2_url_filter(spark, data).collect()}
    for r in pages.select("page_id", "url").collect():
        host, path = re.match(r"https?://([^/?#:]+)(?::[0-9]+)?([^#]*)", r.url.lower()).groups()
        seen = set()
        for mark, part in (("h", "^" + host + "$"), ("p", "^" + path + "$")):
            for n in (3, 4, 5):
                for i in range(len(part)):
                    if i == 0 or i + n <= len(part):
                        seen.add(mark + part[i : i + n])
        z = w[-1] + sum(w[zlib.crc32(g.encode()) >> 16] for g in seen) / len(seen) ** 0.5
        assert abs(got[r.page_id].p_unwanted - 1 / (1 + np.exp(-z))) < 1e-9 and got[r.page_id].keep == (got[r.page_id].p_unwanted < 0.5)


def test_url_edges(spark):
    rows = [(1, "https://hot-casino.bet/slots/play-now"), (2, None), (3, "no url"), (4, ""), (None, "https://www.library.edu/docs"), (5, "HTTPS://USER:pw@HOT-CASINO.BET:8080/slots/play-now#top"), (1, "https://hot-casino.bet/slots/play-now"), (6, "https://a.org/" + "x" * 100_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, keep string")
    got = urls.score(df).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and [by[k].keep for k in (1, 2, 3, 4, None, 5)] == [False, True, True, True, True, False]
    assert by[2].p_unwanted is None and by[1].p_unwanted == by[5].p_unwanted
    assert urls.score(df.limit(0)).count() == 0
    empty = spark.createDataFrame([], "url string, unwanted int")
    assert all(r.keep for r in urls.score(df, empty).collect())
    own = spark.createDataFrame([(u, 1 - y) for u, y in urls.LABELLED], "url string, unwanted int")
    assert {r.page_id: r.keep for r in urls.score(df, own).collect()}[1]
