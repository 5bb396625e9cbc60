"""Operator 2: URL filter, a logistic regression on hashed character n-grams of host and path.

The model is trained on a small labelled table of URLs (column url, column unwanted 0/1; LABELLED by default, at most ``train_rows`` of them) and
scores every URL of the table it is applied to, on the executors. Only the URL column is read.

Defined cases: a null URL, and one without a host, get a null score and are kept; a score equal to the threshold isn't kept; case, port, scheme, user and fragment don't
count; a URL of any length is read whole, each n-gram of it once; page_ids may be of any type, null or repeated; repeated rows are scored alike; an empty table gives no rows; an empty training table gives score 0.5 and keeps all;
other columns aren't read.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BITS = 16
SIZES = (3, 4, 5)
_URL = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)(?::\d+)?([^#]*)", re.I)

_HOSTS = {
    1: "casino-royal.bet lucky-slots777.win poker-bonus.club xxx-videos.sex hot-porn-tube.xxx adult-dating.cam live-sexcams.date cheap-viagra-pills.pharmacy replica-watches.shop free-movies-torrent.to warez-crack.download doubleclick-ads.click adserver.trackpix.biz popads-banner.top payday-loans-fast.loan crypto-doubler.vip free-iphone-winner.gift keygen-serials.ru hotgirls-chat.webcam cialis-online.bid betting-odds.bet jackpot-spin.games pirate-proxy.to click-track.link".split(),
    0: "news.example.com www.example.org blog.travelnotes.net en.encyclopedia.org docs.library.edu m.dailypost.com www.university.edu science.journal.org recipes.homecook.net forum.gardeners.org museum.city.gov www.weather.gov history.archive.org m.sportsdesk.net tech.review.com shop.bookstore.com health.clinic.org www.parliament.gov open.courses.edu music.concerts.net wiki.maths.org code.project.io www.localnews.co.uk blog.example.net".split(),
}
_PATHS = {
    1: "/free-spins-bonus?aff=91 /xxx/teen-video-7.html /buy-viagra-no-prescription /login.php?redirect=win /click?ad=728x90&cid=4 /porn/gallery/12 /torrent/full-movie-hd /casino/slots/play-now /serial-keygen-crack.exe /banner/pop.js?zone=3 /hot-singles-near-you /earn-money-fast".split(),
    0: "/en/825?page=2&ref=x /fr/25#top /news/2021/05/story.html /article/12345 /wiki/History_of_printing /de/770/ /blog/2019/travel-to-lisbon /es/853?utm_source=feed /docs/guide/chapter-3.html /recipes/apple-pie /about /research/papers/17.pdf / /archive/1998/12 /en/960 /questions/441/how-to-prune-roses".split(),
}
#: Well-known sites of both kinds.
_SITES = {
    1: "pornhub.com xvideos.com xhamster.com redtube.com youporn.com xnxx.com spankbang.com chaturbate.com stripchat.com livejasmin.com brazzers.com bet365.com betway.com betfair.com 1xbet.com bwin.com unibet.com pokerstars.com 888casino.com 888poker.com stake.com partypoker.com ladbrokes.com paddypower.com draftkings.com thepiratebay.org 1337x.to rarbg.to limetorrents.lol torrentz2.nz kickasstorrents.to doubleclick.net adnxs.com popads.net propellerads.com adsterra.com clickadu.com exoclick.com trafficjunky.com juicyads.com canadianpharmacy.com malware-site.tk phishing-login.ml free-download-crack.tk".split(),
    0: "wikipedia.org youtube.com github.com nytimes.com bbc.co.uk stackoverflow.com theguardian.com lemonde.fr spiegel.de elpais.com nature.com arxiv.org mit.edu stanford.edu nasa.gov nih.gov who.int europa.eu archive.org gutenberg.org medium.com reddit.com quora.com imdb.com goodreads.com britannica.com nationalgeographic.com weather.com espn.com allrecipes.com bonappetit.com etsy.com ikea.com booking.com tripadvisor.com linkedin.com mozilla.org python.org apache.org debian.org kernel.org w3.org ietf.org".split(),
}
#: Words of host names: unwanted ones, and ordinary ones that stand beside either kind, so that the unwanted word decides.
_WORDS = {
    1: "casino bet bets betting gambling slots poker jackpot viagra cialis pills meds adult xxx porn sex sexcams escorts ads adserver banner popads clicks tracker warez torrent keygen crack pirate payday replica doubler spam phishing malware".split(),
    0: "news weather travel wiki library garden cook sports science book tech clinic music maths history post health green shop press race record learning advice road night school hiking reader river letters free best cheap online city street loading interest thomas others nation".split(),
}
_SUFFIXES = "example.com example.org example.net com org net".split()
_PREFIXES = ["", "www.", "m.", "blog."]


def _labelled() -> list[tuple[str, int]]:
    """Hosts with paths of their own kind; then unwanted hosts, and names of both classes under the same suffixes, with ordinary paths. Names of chance letters are
    ordinary, unless an unwanted word stands beside them."""
    out = [(f"https://{h}{p}", y) for y in (0, 1) for h, p in itertools.product(_HOSTS[y], _PATHS[y])]
    out += [(f"https://{h}{p}", 1) for h, p in itertools.product(_HOSTS[1], _PATHS[0])]
    plain, k = _WORDS[0], 0
    for y in (0, 1):
        for i, word in enumerate(_WORDS[y]):
            beside = [plain[(7 * i + 5 * j + 1) % len(plain)] for j in range(8)]
            for name in [word, *(f"{word}-{w}" if j % 2 else f"{w}-{word}" for j, w in enumerate(beside) if w != word)]:
                for suffix in (_SUFFIXES[k % 6], _SUFFIXES[(k + 2) % 6]):
                    out.append((f"https://{_PREFIXES[k // 2 % 4]}{name}.{suffix}{_PATHS[0][k % len(_PATHS[0])]}", y))
                    k += 1
    out += [(f"https://{'www.' if k % 2 else ''}{h}{p}", y) for y in (0, 1) for k, h in enumerate(_SITES[y]) for p in _PATHS[0][k % 4 :: 4] + _PATHS[y][k % 3 :: 4]]
    rng = np.random.default_rng(0)
    chance = lambda: "".join(rng.choice(list("aaabcdeeeefghhiiijklmnnnooopqrrrssstttuvwxyz"), int(rng.integers(2, 9)))) + str(rng.choice(["", "", "ing", "er", "ed", "tion", "es"]))
    names = [(f"{word}-{chance()}" if j % 2 else f"{chance()}-{word}", y) for y in (0, 1) for word in _WORDS[y] for j in range(20)]
    for name, y in names + [(chance(), 0) for _ in range(1200)]:
        out.append((f"https://{_PREFIXES[k // 2 % 4]}{name}.{_SUFFIXES[k % 6]}{_PATHS[0][k % len(_PATHS[0])]}", y))
        k += 1
    return out


#: The small labelled table.
LABELLED = _labelled()


def grams(url: str | None) -> np.ndarray | None:
    """Hashed n-grams of host and path, each once; None without a host."""
    if not url or not (m := _URL.match(url.strip())):
        return None
    out = set()
    for mark, part in (("h", f"^{m[1].lower()}$"), ("p", f"^{m[2].lower()}$")):
        out.update(mark + part[i : i + n] for n in SIZES for i in range(max(1, len(part) - n + 1)))
    return np.fromiter((zlib.crc32(g.encode()) >> (32 - BITS) for g in out), np.int32, len(out))


def train(rows: list[tuple[str, int]], rounds: int = 200, l2: float = 1e-4) -> np.ndarray:
    """Weights and, last, the bias (Adagrad, full batches); values are 1 / sqrt(number of n-grams)."""
    weights = np.zeros((1 << BITS) + 1)
    known = [(g, y) for g, y in ((grams(u), y) for u, y in rows) if g is not None and y is not None]
    if not known:
        return weights
    size = np.array([len(g) for g, _ in known])
    index, value, y = np.concatenate([g for g, _ in known]), np.repeat(1 / np.sqrt(size), size), np.array([y for _, y in known], float)
    start, row = np.cumsum(size) - size, np.repeat(np.arange(len(known)), size)
    balance = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    square = np.full(len(weights), 1e-8)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(np.add.reduceat(weights[index] * value, start) + weights[-1])))
        d = (p - y) * balance
        g = np.bincount(index, d[row] * value, len(weights))
        g[-1] = d.sum()
        g += l2 * weights
        square += g * g
        weights -= 0.2 * g / np.sqrt(square)
    return weights


def score(pages: DataFrame, labelled: DataFrame | None = None, url_col: str = "url", id_col: str = "page_id", threshold: float = 0.5, train_rows: int = 20_000) -> DataFrame:
    """(page_id, p_unwanted, keep) of every row; keep where p_unwanted is below the threshold. train_rows bounds the training table (by a hash)."""
    rows = LABELLED
    if labelled is not None:
        # a small table by contract; the bound holds if it isn't
        ordered = labelled.select("url", "unwanted").selectExpr("url", "unwanted", "xxhash64(url) AS h").orderBy("h", "url", "unwanted").limit(train_rows)
        rows = [(r.url, r.unwanted) for r in ordered.collect()]
    shared = pages.sparkSession.sparkContext.broadcast(train(rows))  # of a fixed size

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            z = [None if (g := grams(u)) is None else float(1 / (1 + np.exp(-(w[g].sum() / len(g) ** 0.5 + w[-1])))) for u in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(z, pa.float64()), pa.array([p is None or p < threshold or not w.any() for p in z], pa.bool_())], ["page_id", "p_unwanted", "keep"])

    return pages.select(id_col, url_col).mapInArrow(apply, f"page_id {pages.schema[id_col].dataType.simpleString()}, p_unwanted double, keep boolean")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/pages.parquet"))
