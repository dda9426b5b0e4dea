"""URL filters: rules on hosts and paths first, else logistic regression on hashed character n-grams.

The classifier is trained on the driver from the small labelled table of URLs below. Host and path have n-grams of their own; a URL is judged in Arrow batches, without a shuffle.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1 << 15
SIZES = (3, 4, 5)
#: The labelled table: wanted pages and unwanted ones, a URL per line, of the kinds that public block lists name. A rule
#: leaves out every fifth of either when the table is split to measure the classifier on words that it hasn't seen.
WANTED = """
https://www.city-library.org/opening-hours
https://news.morningpost.com/world/2021/04/election-results
http://museum-of-glass.org/exhibitions/current
https://www.gardenclub.net/plants/roses/pruning
https://weather.coastguard.org/forecast/weekly
https://docs.pythonhandbook.org/tutorial/functions.html
https://www.university-press.org/journals/history
http://forum.woodworkers.net/threads/oak-table
https://recipes.familykitchen.com/soup/tomato
https://blog.trailrunner.org/2019/10/autumn-in-the-hills
https://www.hospital-trust.org/departments/cardiology
http://maps.hikingroutes.net/alps/day-three
https://en.encyclopedia-project.org/articles/photosynthesis
https://www.theatre-royal.com/season/programme
https://science.observatory.org/papers/star-clusters
http://www.parish-council.org/minutes/2018/march
https://music.conservatory.net/students/concerts
https://www.birdwatch.org/species/heron
https://support.openeditor.org/guides/install
http://travel.railwayguide.com/norway/bergen-line
https://www.primary-school.net/parents/calendar
https://archive.localhistory.org/maps/1890
https://www.bakery-on-the-corner.com/about
http://chess.society.org/lessons/endgames
https://football.countyleague.net/fixtures/2022
https://www.law-review.org/issues/44/property
https://health.ministry.org/advice/vaccination
http://astronomy.club.net/gallery/moon
https://www.bookshop-by-the-river.com/events/readings
https://data.statistics-office.org/tables/population
https://www.harbourfestival.com/visitors/map
http://poetry.quarterly.org/spring/poems
https://blog.beekeepers.net/2020/05/swarming
https://www.engineering-institute.org/standards/bridges
https://kids.storytime.org/tales/the-fox
http://www.village-hall.net/bookings
https://dev.compiler-notes.org/posts/parsing
https://www.art-gallery.com/painters/landscape
https://cycling.union.org/routes/north-sea
http://water.research.net/rivers/report-2017
https://www.daily-courier.com/business/markets-today
https://wiki.linguists.org/grammar/dative-case
https://shop.pottery-studio.com/bowls
http://www.church-choir.org/rehearsals
https://film.archive.net/directors/silent-era
https://www.nature-reserve.org/volunteers
https://learn.mathcircle.org/problems/geometry
http://www.fishermens-museum.com/boats
https://open.transport-data.org/timetables
https://www.tea-garden.net/menu
""".split()
UNWANTED = """
http://best-casino-bonus.com/free-spins
http://www.cheapmeds-online.net/order/viagra
http://hot-singles.xxx-dates.com/join
http://poker-jackpot.net/win/now
http://fast-payday-loans.com/apply?ref=ad
http://buy-cheap-pills.net/no-prescription
http://free-porn-tube.com/videos/adult
http://win-a-free-phone.com/claim/prize
http://replica-watches-sale.com/rolex
http://adserver.clicktrack.net/banner?id=77
http://www.lottery-winners.com/you-won
http://slots-and-bets.com/bonus/deposit
http://spamlist-seller.net/bulk-mail
http://weight-loss-miracle.com/buy-now
http://track.adnetwork.com/pixel.gif
http://warez-downloads.net/crack/serial
http://sexcams-live.com/free
http://www.get-rich-quick.net/secret-method
http://popup-ads.com/click/offer
http://betting-tips-win.com/sure-odds
http://online-pharmacy-discount.com/cialis
http://adult-video-chat.net/girls
http://free-gift-cards.com/survey/claim
http://casino-royal-bets.net/roulette/bonus
http://link-farm-seo.com/backlinks/buy
http://ads.traffic-exchange.net/redirect?u=1
http://cheap-viagra-pills.com/shop/buy
http://keygen-torrents.net/full-version
http://escort-girls.xxx/city
http://crypto-doubler.com/invest/profit
http://miracle-diet-pills.net/order-now
http://spam-tools.com/harvester
http://scratch-and-win.net/bonus/free
http://doubleads.clickfarm.com/track?c=9
http://nude-celebs-free.com/pics
http://loan-approval-instant.net/bad-credit
http://fake-designer-bags.com/sale
http://bet-on-football-win.com/free-bet
http://tracking-cookies.adsystem.net/sync
http://penny-stock-alert.com/buy-signal
http://free-ringtones-win.net/subscribe
http://xxx-adult-toys.com/shop
http://mega-casino-slots.com/play
http://bulk-followers-cheap.com/buy
http://malware-cleaner-free.net/download.exe
http://pills-without-doctor.com/checkout
http://sweepstakes-winner.net/prize/claim
http://adclick-tracker.com/go?aff=12
http://erotic-stories-free.com/adult
http://bitcoin-casino-bets.com/deposit
""".split()


def labelled_urls(wanted: list[str] = WANTED, unwanted: list[str] = UNWANTED) -> list[tuple[str, str, int]]:
    """(host, path, 1 if unwanted) of the table. A host stands under each of three endings, with and without ``www.``, and with the
    path ``/`` too, so none of these tells anything by itself."""
    rows = []
    for urls, y in ((wanted, 0), (unwanted, 1)):
        for url in urls:
            host, path = parts_of(url)
            name = host.removeprefix("www.").rpartition(".")[0]
            for k, top in enumerate(("com", "org", "net")):
                rows += [(f"{'www.' if k % 2 else ''}{name}.{top}", path, y), (f"{'' if k % 2 else 'www.'}{name}.{top}", "/", y)]
    return rows


def parts_of(url: str) -> tuple[str, str]:
    """(host, path) as ``split_url`` has them."""
    rest = url.partition("://")[2]
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    path = rest[end:]
    stop = next((i for i, c in enumerate(path) if c in "?#"), len(path))
    return rest[:end].lower(), path[:stop]


def features(host: str, path: str) -> np.ndarray:
    """Distinct hashed n-grams of both parts; the marks ^ and $ stand for the ends."""
    import zlib

    found = set()
    for tag, s in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for size in SIZES:
            for k in range(len(s) - size + 1):
                found.add(zlib.crc32(f"{tag}{s[k : k + size]}".encode("utf-8", "surrogatepass")) % DIMENSIONS)
    return np.fromiter(found, dtype=np.int64, count=len(found))


def train(rows: list[tuple[str, str, int]] | None = None, rounds: int = 200, rate: float = 0.5, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Full-batch gradient descent from zero on ``rows``, the labelled table by default: the same weights on every run."""
    rows = labelled_urls() if rows is None else rows
    x = [features(h, p) for h, p, _ in rows]
    y = np.array([r[2] for r in rows], dtype=float)
    at = np.repeat(np.arange(len(x)), [len(v) for v in x])
    flat = np.concatenate(x)
    scale = 1 / np.sqrt(np.array([len(v) for v in x], dtype=float))
    w, b = np.zeros(DIMENSIONS), 0.0
    for _ in range(rounds):
        z = np.bincount(at, w[flat], minlength=len(x)) * scale + b
        g = (1 / (1 + np.exp(-z)) - y) / len(x)
        w -= rate * 20 * (np.bincount(flat, (g * scale)[at], minlength=DIMENSIONS) + ridge * w / 20)
        b -= rate * g.sum()
    return w, float(b)


def unwanted_score(host: str, path: str, model: tuple[np.ndarray, float]) -> float:
    w, b = model
    f = features(host, path)
    return float(1 / (1 + np.exp(-(w[f].sum() / np.sqrt(max(len(f), 1)) + b))))


def split_url(url):
    """(host, path): see ``judge_urls``."""
    ok = F.instr(url, "://") > 0
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(ok, F.translate(host, upper, lower)).otherwise(""), F.when(ok, path).otherwise("")


def judge_urls(df: DataFrame, rules: list[tuple[str, str, str]], *, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """(id, host, path, rule, verdict, score) for every row of ``df``.

    ``rules`` are (verdict, host, path). The host is what follows the first ``://`` up to ``/ ? #``, A-Z lower-cased;
    the path goes on up to ``? #``. A null url, or one without ``://``, has neither. A rule fits its host and the
    subdomains if the path starts with the rule's; of several the longest (host and path together, then the
    first given) wins. Without a rule the classifier decides, for a url without host and path too. Very long urls are read
    whole. An empty table gives an empty result. Repeated rows get equal verdicts; other columns are not read.
    """
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    host, path = split_url(url)
    split = df.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2]), reverse=True)[::-1]:
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit(f".{h}"))) & F.startswith(F.col("path"), F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    ruled = split.withColumn("rule", name).withColumn("verdict", verdict)
    model = train()

    def run(batches):
        import pyarrow as pa

        @lru_cache(maxsize=50_000)
        def score(h, p):
            return unwanted_score(h, p, model)

        for batch in batches:
            hosts, paths, verdicts = (batch.column(k).to_pylist() for k in (1, 2, 4))
            scores = [score(h, p) for h, p in zip(hosts, paths, strict=True)]
            final = [v or ("block" if s >= threshold else "allow") for v, s in zip(verdicts, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(final, pa.string()), pa.array(scores, pa.float64())], names=["id", "host", "path", "rule", "verdict", "score"])

    kind = dict(split.dtypes)["id"]
    return ruled.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string, score double").withColumnRenamed("id", id_col)
