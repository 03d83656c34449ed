"""URL filters: allow and block rules, and logistic regression on hashed character n-grams for all other urls.

A rule names a host and the start of a path. It fits a url on that host or any subdomain whose path starts so; of the
rules that fit, the longest wins. A url without a rule is judged by a logistic regression over hashed n-grams of 3 to 6
characters of its host and its path, trained from a small labelled url table (:func:`labelled_urls`) with a fixed
seed. The table is made from general words of unwanted and of ordinary sites, joined by rule; it names no site, and
ordinary words that look like unwanted ones are among it. What a rule settles is not scored.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed, as there is
nothing to judge; rows are judged one by one, so repeated rows get equal verdicts and an empty table gives an empty
result. Other columns don't matter.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import core
from .url_parts import host_of, path_of


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

#: Buckets of the hashed n-grams; the weights are this many numbers.
BUCKETS = 1 << 16
GRAMS = (3, 4, 5, 6)

# Fixed values of the labelled table: general words of unwanted sites, by topic.
UNWANTED = (
    "casino poker roulette blackjack baccarat bingo jackpot slot slots betting bet bets bookmaker gamble gambling lottery lotto wager vegas sportsbet",
    "pill pills pharma pharmacy viagra cialis levitra xanax tramadol meds drugs steroid steroids pharmacies generic dosage erectile",
    "porn porno sex sexy xxx nude nudes naked escort escorts adult webcam cams camgirls fetish erotic milf singles hookup hookups dating hentai",
    "warez torrent torrents crack cracked keygen nulled serials pirate piratebay rapidshare repack patcher modapk",
    "adserver adserve adclick advert adverts advertising banner banners popunder popads popup tracker tracking clicktrack clickbait malvertising affiliate doubleclick ads adnetwork adtech",
    "spam spammer backlink backlinks linkfarm linkbuilding followers likes traffic bulkmail autosurf doorway seoboost",
    "malware spyware phishing phish trojan ransomware keylogger exploit botnet hacked hacks verifyaccount accountverify securelogin",
    "payday loan loans lender cash cashadvance creditfix debtrelief moneyfast getrich millionaire forex binaryoptions doubler bitcoin airdrop giveaway moneymaker earnfast",
    "replica replicas counterfeit fakewatches knockoff rolex handbags outlet jerseys",
)
#: Words that join the former.
PITCH = "cheap cheapest best hot free online buy win winner now live big lucky fast easy discount bonus club king zone hub world deals super mega real top instant cheapo royal prize money farm track shop".split()
#: Words of ordinary sites, among them some that look like unwanted ones.
ORDINARY = (
    "news weather garden library museum school history science travel recipe recipes cooking book books music football city council university research health advice open data forum astronomy "
    "local farm life window windows therapist therapy essex sussex middlesex bookbinder adapt athletics casual freedom between code codecamp camp learn learning pillsbury pillow pillar caterpillar "
    "spillway address adventure advance admin adobe adidas academy radio read reader thread shadow meadow road roads broadcast download better alphabet bethlehem beta diabetes tibet elizabeth "
    "assess class classic bass compass glass grass passage cocktail cocktails peacock hancock dictionary title titles document documents analysis analytics cashew cashmere castle casa cascade "
    "cassette porto portal report support sport sports export airport important winter wine wind winnipeg twin edwin darwin slow slovenia lotus pilot spotlight poke pocket spoke bingley gambia "
    "trackpad racetrack crackers cracker nutcracker firecracker cream spa space spanish spatial banneker bannerman hub github gitlab stack overflow wiki wikipedia encyclopedia times post guardian "
    "journal daily review reviews magazine press gazette herald tribune observer mail email online shop store market bakery bakehouse coffee tea house home family kids child children parents art "
    "arts gallery theatre theater cinema film films photo photos photography design studio software hardware computer linux python java data cloud network systems engineering physics chemistry "
    "biology math nature animals birds dogs cats horse horses fish fishing boats bikes cycling running yoga fitness clinic hospital doctor dentist medicine medical nurse care church charity trust "
    "foundation institute college students teacher education jobs career law legal court justice police fire rescue government parliament bank banking finance insurance invest economy business "
    "company industry energy solar water earth climate ocean river mountain forest park trail maps hotel hotels flights trains bus car cars auto motor repair tools garage building architect "
    "fashion style beauty hair food kitchen restaurant pizza vegan organic fruit apple orange cherry green blue red white black silver golden sunshine moon star sky free open first next "
    "live world big best real easy fast king royal club money win track farm hot top now big"
).split()
DOMAINS = "com org net info biz io co.uk de fr es it nl ru".split()
FRONTS = ("", "", "", "www.", "blog.", "m.", "shop.", "news.")


def _name(r: random.Random) -> str:
    """A name that is no word: letters and pairs of letters as they come in many tongues."""
    return "".join(r.choice("bcdfghjklmnprstvwz") * (r.random() < 0.8) + r.choice(["a", "e", "i", "o", "u", "ai", "ou", "y"]) + r.choice(["", "", "n", "r", "s", "t", "l", "nd", "st", "th"]) for _ in range(r.randint(1, 4)))


def labelled_urls(rows: int = 6000, seed: int = 5) -> list[tuple[str, str, int]]:
    """A small table of (host, path, 1 for unwanted), made by rule from the words above."""
    r = random.Random(seed)
    topics = [t.split() for t in UNWANTED]
    out = []
    for _ in range(rows):
        bad = r.random() < 0.5
        if bad:
            words = [r.choice(r.choice(topics))]
            for _ in range(r.choice([0, 1, 1, 2])):
                other = r.choice(PITCH) if r.random() < 0.6 else r.choice(r.choice(topics)) if r.random() < 0.5 else r.choice(ORDINARY)
                words.insert(r.randint(0, len(words)), other)
        elif r.random() < 0.35:
            words = [_name(r) for _ in range(r.choice([1, 1, 2]))]
        else:
            words = [r.choice(ORDINARY) for _ in range(r.choice([1, 2, 2, 3]))]
        name = r.choice(["-", "", ""]).join(words) + (str(r.randint(1, 99)) if r.random() < 0.1 else "")
        host = r.choice(FRONTS) + f"{name}.{r.choice(DOMAINS)}"
        path = "/" + "/".join(r.choice(ORDINARY) if r.random() < 0.7 else str(r.randint(0, 9999)) for _ in range(r.randint(0, 3)))
        if bad and r.random() < 0.25:
            path = f"/{r.choice(['-', ''])}".join(["", r.choice(r.choice(topics))]) + path
            if r.random() < 0.5:  # an ordinary host, and the path alone tells
                host = f"{_name(r)}.{r.choice(DOMAINS)}"
        out.append((host, path, int(bad)))
    return out


_PARTS = re.compile(r"[a-z]+|[^\x00-\x7f]+")


def parts_of(host: str, path: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """The words that are judged: of the host's labels without the domain, and of the path."""
    labels = host.partition(":")[0].split(".")
    return tuple(w for x in labels[:-1] or labels for w in _PARTS.findall(x)), tuple(w for w in _PARTS.findall(path.lower()) if len(w) > 2)


def grams(host: Sequence[str], path: Sequence[str]) -> np.ndarray:
    """Buckets of the distinct n-grams of the words."""
    found = set()
    for sign, words in (("h", host), ("p", path)):
        for w in words:
            text = f"^{w}$"
            found.update(sign + text[i : i + n] for n in GRAMS for i in range(len(text) - n + 1))
    return np.fromiter({zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in found}, np.int64)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def score(self, host: str, path: str) -> float:
        """Over 0: unwanted."""
        return float(self.scores([parts_of(host, path)])[0])

    def scores(self, rows: Sequence[tuple[Sequence[str], Sequence[str]]]) -> np.ndarray:
        """Scores of many urls at once, by their words."""
        found = [grams(*x) for x in rows]
        sizes = np.array([len(x) for x in found], np.int64)
        sums = np.bincount(np.repeat(np.arange(len(rows)), sizes), self.weights[np.concatenate([*found, np.zeros(0, np.int64)])], len(rows))
        return sums / np.sqrt(np.maximum(1, sizes)) + self.bias


def train(rows: Sequence[tuple[str, str, int]], steps: int = 300, rate: float = 2.0, decay: float = 1e-4) -> Model:
    """Logistic regression by gradient descent with momentum over all rows; features of a row have length 1."""
    found = [grams(*parts_of(h, p)) for h, p, _ in rows]
    sizes = np.array([len(x) for x in found])
    row, at = np.repeat(np.arange(len(rows)), sizes), np.concatenate(found)
    value = 1 / np.sqrt(np.maximum(1, sizes))[row]
    y = np.array([x[2] for x in rows], float)
    w, b, mw, mb = np.zeros(BUCKETS), 0.0, np.zeros(BUCKETS), 0.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(np.bincount(row, w[at] * value, len(rows)) + b))) - y
        mw = 0.9 * mw + np.bincount(at, error[row] * value, BUCKETS) / len(rows) + decay * w
        mb = 0.9 * mb + error.mean()
        w, b = w - rate * mw, b - rate * mb
    return Model(w.astype(np.float32), float(b))


@lru_cache(1)
def model() -> Model:
    return train(labelled_urls())


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[Rule] = RULES, found: Model | None = None) -> DataFrame:
    """One row for each row: id, host, path, rule (null: none fits), verdict (allow or block)."""
    found = found or model()
    rows = core(pages, id_col, url_col).select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))

    def first(pick) -> Column:
        out = F.lit(None).cast("string")
        for r in sorted(rules, key=lambda x: len(str(x))):  # the longest is asked first
            fits = ((F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host))) & F.startswith(F.col("path"), F.lit(r.path))
            out = F.when(fits, F.lit(pick(r))).otherwise(out)
        return out

    @F.pandas_udf(T.BooleanType())
    def unwanted(host, path):
        import pandas as pd

        # a url that a rule settles has no host here; equal words are scored once
        keys = [parts_of(h, p) if h else None for h, p in zip(host, path, strict=True)]
        distinct = list({k for k in keys if k})
        bad = dict(zip(distinct, found.scores(distinct) > 0, strict=True))
        return pd.Series([bool(k) and bool(bad[k]) for k in keys], dtype=bool)

    settled = first(lambda r: r.verdict)
    return rows.select(
        id_col, "host", "path", first(str).alias("rule"),
        F.coalesce(settled, F.when(unwanted(F.when(settled.isNull(), F.col("host")), "path"), "block").otherwise("allow")).alias("verdict"),
    )
