"""URL filters: rules on host and path, and for the rest logistic regression on hashed character n-grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: What names hosts to block, and hosts to allow.
BLOCK_WORDS = (
    "ads ad adserver adclick adtrack banner popup popunder tracker clickbait doubleclick sponsor affiliate adult xxx porn sexcam webcam escort "
    "nude hentai erotic fetish hookup casino slots poker roulette jackpot betting bets sportsbet gamble lottery bingo pills viagra cialis pharma "
    "steroid weed warez crack keygen serial torrent piratebay nulled cracked phish phishing malware trojan ransom spyware exploit botnet spam scam "
    "fraud fakebank giveaway prize winner cheap free replica counterfeit payday loans fastcash getrich cryptopump airdrop doubler clickfarm linkfarm"
).split()
ALLOW_WORDS = (
    "news times herald post journal daily press radio museum library archive gallery theatre cinema concert music orchestra opera dance poetry "
    "books novels writer author science physics chemistry biology botany geology astronomy maths statistics engineering university college school "
    "institute academy campus student teacher lessons course health clinic hospital dental nutrition fitness yoga running cycling football tennis "
    "hockey swimming hiking mountain river forest garden flowers farm kitchen recipes baking coffee tea wine restaurant travel hotel railway airport "
    "harbour weather climate energy solar water city council government parliament court police history heritage castle church temple culture language "
    "dictionary grammar translate maps atlas photo camera film art design craft pottery knitting furniture house home family kids toys puzzle chess "
    "games software python linux database network hardware robots electronics repair cars bikes boats trains planes shop market bookstore bakery "
    "finance economy budget tax insurance jobs career office business startup charity society club forum blog wiki docs guide manual reviews stories"
).split()
#: What hosts to block are dressed up with, whatever they sell; names that are made to be thrown away, and ways to an offer.
LURES = "best top free cheap online 24 247 vip win now deals 4u pro hot club bonus review direct discount official real fast easy super mega".split()
CHEAP_SUFFIXES, OFFERS = ("xyz", "top", "click", "biz", "info", "win"), ("/go/{n}", "/offer/{n}", "/promo/{word}", "/click/{n}", "/aff/{n}/{word}", "/bonus")
#: Letters of invented names, which are no words and have to tell nothing.
ONSETS, VOWELS, CODAS = "b br ch d f g h j k l m n p r s sh st t th tr v w wh z".split(), "a e i o u ea ie ou".split(), " n r s t l nt st ng th nd ble tion er ly".split(" ")
PREFIXES, SUFFIXES = ("", "www.", "m.", "blog."), ("com", "net", "org", "example.com", "example.net", "example.org", "info", "de", "co.uk")
PATHS = ("", "/", "/{lang}/{n}", "/{lang}/{n}.html", "/{lang}/{n}/", "/{word}", "/{word}/{n}", "/{word}/index.html", "/{lang}/{word}/{n}.html", "/index.php", "/a/{word}-{n}.html", "/{n}")
LANGUAGES = ("en", "de", "fr", "es")
HELD_OUT = 5


class Labelled(NamedTuple):
    url: str
    label: int  # 1 to block, 0 to allow
    word: str  # what names the host, or the path
    family: str  # the suffix of its host


def labelled_table(n: int = 12_000) -> list[Labelled]:
    """The small labelled table: n invented urls, the same every time.

    A third is to block: one of BLOCK_WORDS names the host, or the path of a neutral host, and most such hosts are dressed up: with
    a lure, digits, a throw-away suffix or a way to an offer. The others have names of ALLOW_WORDS or of no words, and such traits seldom.
    """
    rng = np.random.default_rng(8)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    name = lambda: "".join(pick(ONSETS) + pick(VOWELS) + pick(CODAS) for _ in range(int(rng.integers(1, 4))))
    neutral = lambda: pick(ALLOW_WORDS) if rng.random() < 0.4 else name()
    out = []
    for i in range(n):
        label, by_path = int(i % 3 == 0), rng.random() < 0.1
        told = pick(BLOCK_WORDS) if label else neutral()
        host = neutral() if label and by_path else told
        if rng.random() < 0.75:
            other = pick(LURES) if label and rng.random() < 0.75 else neutral()
            join = "-" if rng.random() < (0.6 if label else 0.25) else ""
            host = host + join + other if rng.random() < 0.5 else other + join + host
        if rng.random() < (0.4 if label else 0.06):
            host += str(int(rng.integers(1, 1000)))
        family = pick(CHEAP_SUFFIXES) if rng.random() < (0.4 if label else 0.03) else pick(SUFFIXES)
        path = pick(OFFERS) if rng.random() < (0.4 if label else 0.02) else pick(PATHS[5:9] if label and by_path else PATHS)
        path = path.format(lang=pick(LANGUAGES), n=int(rng.integers(1, 10_000)), word=told if by_path else neutral())
        out.append(Labelled(f"http{pick(('', 's'))}://{pick(PREFIXES)}{host}.{family}{path}", label, told, family))
    # Without a host nothing speaks for a block.
    return out + [Labelled(f"about:{i}", 0, "", "") for i in range(n // 100)]


def held_out(row: Labelled) -> bool:
    """One word of HELD_OUT, and two families of hosts, are kept from the training: no row of it has them."""
    return bool(row.word) and zlib.crc32(row.word.encode()) % HELD_OUT == 0 or row.family in ("biz", "de")


SIZES = (3, 4, 5)
BITS = 17
BUCKETS = 1 << BITS
#: Few epochs: more learn the words by heart, and find fewer hosts of words that were not there.
EPOCHS, RATE, L2 = 4, 0.3, 1e-6


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, else null; of rules of one length the first. Rules are a parameter, not data."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


#: URLs that are looked at together, of whatever length: characters of a slice.
SLICE_CHARS = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def buckets(hosts: Sequence[str], paths: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hash buckets, once each, of the n-grams of ``^host$`` and of ``^path$``, each kind by itself."""
    texts = [f"^{t}$" for pair in zip(hosts, paths, strict=True) for t in pair]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    found, h = [], (codes + np.uint64(1)) * _ODD + (owner % 2).astype(np.uint64)
    for n in range(2, SIZES[-1] + 1):
        if len(codes) < n:
            break
        h = (h[:-1] + codes[n - 1 :] + np.uint64(1)) * _ODD
        if n in SIZES:
            inside = owner[: len(h)] == owner[n - 1 :]
            at = ((h ^ (h >> np.uint64(29))) * _ODD >> np.uint64(64 - BITS)).astype(np.int64)
            found.append(((owner[: len(h)] // 2) * BUCKETS + at)[inside])
    rows, at = np.divmod(np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64), BUCKETS)
    return rows, at


LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2]
    ends = [i for c in "/?#" if (i := rest.find(c)) >= 0]
    cut = min(ends, default=len(rest))
    return rest[:cut].translate(LOWER), rest[cut:].partition("?")[0].partition("#")[0]


class Model(NamedTuple):
    weights: np.ndarray
    bias: float

    def scores(self, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
        """Chances to be blocked, of slices of about SLICE_CHARS."""
        out, at = np.empty(len(hosts)), 0
        sizes = np.cumsum([len(h) + len(p) + 4 for h, p in zip(hosts, paths, strict=True)])
        while at < len(hosts):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_CHARS, "right")))
            rows, found = buckets(hosts[at:end], paths[at:end])
            n = np.bincount(rows, minlength=end - at)
            total = np.bincount(rows, self.weights[found], end - at)
            out[at:end] = 1 / (1 + np.exp(-np.clip(self.bias + total / np.sqrt(np.maximum(1, n)), -500, 500)))
            at = end
        return out


def train(labelled: Sequence[tuple[str, int]]) -> Model:
    """Weights of the buckets and the intercept, by AdaGrad over the whole small table, a row after another. Labels weigh alike."""
    n1 = sum(label for _, label in labelled)
    weight = ((len(labelled) - n1) / n1 if n1 else 1.0, 1.0)
    owner, found = buckets(*zip(*[split_url(url) for url, _ in labelled], strict=True))
    rows = np.split(found, np.searchsorted(owner, np.arange(1, len(labelled))))
    w, g2 = np.zeros(BUCKETS, np.float32), np.full(BUCKETS, 1e-4, np.float32)
    b, rng = 0.0, np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            at = rows[i]
            x = 1 / np.sqrt(max(1, len(at)))
            error = weight[1 - labelled[i][1]] * (1 / (1 + np.exp(-(b + float(w[at].sum()) * x))) - labelled[i][1])
            g = np.float32(error * x) + np.float32(L2) * w[at]
            g2[at] += g * g
            w[at] -= np.float32(RATE) * g / np.sqrt(g2[at])
            b -= 0.02 * error
    return Model(w, b)


@lru_cache(1)
def shipped_model() -> Model:
    """The model of the labelled table's training rows."""
    return train([(r.url, r.label) for r in labelled_table() if not held_out(r)])


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labelled: Sequence[tuple[str, int]] | None = None) -> DataFrame:
    """page_id, host, path, rule, score and verdict of every page: the rule's verdict, else ``block`` at a score of 0.5.

    The model is trained on ``labelled`` (url, 1 to block or 0), by default on the training rows of labelled_table(); it is BUCKETS
    numbers, however many pages there are. Null urls and urls without ``://`` have an empty host and path; these have only the
    n-grams of two empty strings. Rows that repeat are judged each by itself, an empty table gives no rows, and other columns of
    ``pages``, of whatever name, are left out.
    """
    model = pages.sparkSession.sparkContext.broadcast(shipped_model() if labelled is None else train(labelled))

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in parts:
            yield pd.Series(model.value.scores(hosts.tolist(), paths.tolist()), dtype=float)

    verdicts = F.lit(None).cast("string")
    for verdict, rule in rules:
        verdicts = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(verdicts)
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    scored = split.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules)).withColumn("score", score("host", "path"))
    return scored.withColumn("verdict", F.coalesce(verdicts, F.when(F.col("score") >= 0.5, "block").otherwise("allow")))
