"""URL filter: rules by host and path, else logistic regression on hashed character n-grams."""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navspark.llm.words import mix

#: (host and path, verdict); a rule fits its host and all subdomains.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

# Words of the labelled table.  Its URLs are made of them by ``labelled``.
BAD = """
pills viagra pharmacy meds pharma diet slim detox casino poker slots jackpot roulette bets betting odds lottery bonus loan payday cash credit debt forex crypto
bitcoin doubler profit invest rich porn xxx adult sex cams nude escort girls dating singles torrent warez crack keygen serial pirate stream movies replica rolex
fake outlet spam seo backlinks clicks traffic followers winner prize giveaway gift claim phish verify login-secure malware virus hack cheat generator farm
ads adserver adult track tracker popunder banner clickbait spyware xrated
""".split()
BAIT = "cheap free best fast hot easy win buy online super now 24 365 king top vip club zone hub deal".split()
GOOD = """
news library school university museum weather garden city council hospital church bank bakery forest river travel recipes music science journal history guide
docs wiki blog shop school kids sport football chess maths physics law court energy water rail bus airport hotel street house work paper letters books film radio
art photo design code data cloud mail maps open world north south health family food wine bike sea island lake mountain village market bird cat dog
""".split()
KNOWN = """
bbc.co.uk nytimes.com theguardian.com lemonde.fr spiegel.de elpais.com nhk.or.jp reuters.com apnews.com cnn.com wikipedia.org wikimedia.org archive.org gutenberg.org
github.com gitlab.com stackoverflow.com python.org apache.org kernel.org debian.org mozilla.org w3.org ietf.org arxiv.org nature.com science.org acm.org ieee.org
mit.edu stanford.edu ox.ac.uk cam.ac.uk ethz.ch europa.eu un.org who.int nasa.gov loc.gov gov.uk service-public.fr bund.de amazon.com ebay.com etsy.com ikea.com
youtube.com vimeo.com reddit.com medium.com wordpress.com blogspot.com tumblr.com flickr.com imdb.com goodreads.com spotify.com booking.com airbnb.com
""".split()
ENDS = "com org net de fr es info io co.uk eu".split()
SOUNDS = "ba be bo ca co da de di do el en er fa fi ga go ha he ho in is ka la le li lo ma me mi mo na ne no on or pa pe po qu ra re ri ro sa se si so st ta te th ti to tr un ur va ve vi wa we wi xa yo za".split()

BITS = 18
GRAMS = (3, 4, 5)


def labelled(n: int = 1500, seed: int = 3) -> list[tuple[str, int]]:
    """The small labelled table: (URL, 1 to block or 0 to allow), half of either.

    Names without a meaning, subdomains, endings and page paths are dealt to
    both labels alike, so they tell nothing.
    """
    rng = random.Random(seed)
    name = lambda: "".join(rng.choice(SOUNDS) for _ in range(rng.randint(2, 4)))

    def path(words: list[str]) -> str:
        number, word = rng.randint(1, 60_000), rng.choice(words)
        lang = rng.choice(["en", "de", "fr", "es", "it", "pt"])
        plain = ["", "/", f"/{lang}/{number}", f"/{lang}/{number}.html", f"/{lang}/{number}/", f"/{lang}/{name()}", f"/p/{name()}-{number}", f"/index.php?id={number}", f"/{name()}/{number}"]
        telling = [f"/{word}", f"/{word}/{number}", f"/{rng.randint(1998, 2024)}/{rng.randint(1, 12)}/{word}-{name()}", f"/{name()}/{word}.html"]
        return rng.choice(plain if rng.random() < 0.8 else telling)

    def host(label: int) -> str:
        if label:
            one, two = rng.choice(BAD), rng.choice(BAD + BAIT)
            return rng.choice([f"{one}-{two}", f"{two}-{one}", f"{two}{one}", f"{one}{two}", f"{one}-{name()}", f"{name()}-{one}", f"{one}{rng.randint(1, 99)}"])
        one, two = rng.choice(GOOD), rng.choice(GOOD)
        return rng.choice([f"{one}-{two}", f"{one}{two}", name(), name(), name(), f"{name()}-{one}", f"{one}-{name()}", one, f"{one}{rng.randint(1, 99)}"])

    rows = []
    for i in range(n):
        label = i % 2
        site = rng.choice(KNOWN) if not label and rng.random() < 0.2 else f"{host(label)}.{rng.choice(ENDS)}"
        if rng.random() < 0.4:  # a site beneath a common one
            site = f"{host(label)}.{name()}.{rng.choice(ENDS)}"
        rows.append((f"http{rng.choice(['', 's'])}://{rng.choice(['', '', 'www.', 'm.', 'blog.'])}{site}{path(BAD if label else GOOD)}", label))
    return rows


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): after the first "://" up to /, ? or #, in lower case; then up to ? or #."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    path = rest[cut:]
    end = min((i for i in (path.find(c) for c in "?#") if i >= 0), default=len(path))
    return rest[:cut].translate(_LOWER), path[:end]


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def _bare(url: Column) -> Column:
    """What stands behind the first "://", or null."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """``split_url``'s host as a column; a null URL has the empty one."""
    host = F.regexp_extract(_bare(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_bare(url), r"^[^/?#]*+(/[^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + start))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def hashed_grams(texts: list[str], part: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, cell) of the distinct character n-grams of texts between end marks; ``part`` keeps host and path apart."""
    marked = [f"^{t.lower()}$" if t else "" for t in texts]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(m) for m in marked])
    found = []
    with np.errstate(over="ignore"):
        for n in GRAMS:
            size = len(points) - n + 1
            if size <= 0:
                continue
            value = reduce(lambda h, k: h * np.uint64(0x100000001B3) + points[k : k + size], range(n), np.full(size, n + 16 * part, np.uint64))
            cell = mix(value) & np.uint64((1 << BITS) - 1)
            inside = owner[:size] == owner[n - 1 :]
            found.append((owner[:size][inside].astype(np.uint64) << np.uint64(BITS)) | cell[inside])
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
    return (both >> np.uint64(BITS)).astype(np.int64), (both & np.uint64((1 << BITS) - 1)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray  # of host cells, then of path cells
    bias: float

    def scores(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """The probabilities that URLs are to be blocked."""
        z = np.full(len(hosts), self.bias)
        for part, texts in enumerate((hosts, paths)):
            text, cell = hashed_grams(texts, part)
            size = np.bincount(text, minlength=len(texts))
            z += np.bincount(text, weights=self.weights[part, cell], minlength=len(texts)) / np.sqrt(np.maximum(size, 1))
        return 0.5 * (1 + np.tanh(z / 2))

    def score(self, host: str, path: str) -> float:
        return float(self.scores([host], [path])[0])


def train(rows: list[tuple[str, int]] | None = None, base_rate: float = 0.3, steps: int = 600, decay: float = 5e-5) -> Model:
    """Logistic regression by gradient descent on a small labelled table; it is fitted on the driver.

    The labels weigh alike in the fit, whose intercept is not decayed; then the
    intercept is moved to the share of URLs to block that is expected on the
    web, ``base_rate``.  So a URL that tells nothing is allowed.
    """
    rows = labelled() if rows is None else rows
    y = np.array([float(label) for _, label in rows])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))
    split = [split_url(url) for url, _ in rows]
    sides = []
    for part in (0, 1):
        text, cell = hashed_grams([s[part] for s in split], part)
        share = 1 / np.sqrt(np.maximum(np.bincount(text, minlength=len(rows)), 1))
        sides.append((text, cell, share[text]))
    model = Model(np.zeros((2, 1 << BITS)), 0.0)
    for _ in range(steps):
        z = np.full(len(rows), model.bias)
        for part, (text, cell, share) in enumerate(sides):
            z += np.bincount(text, weights=model.weights[part, cell] * share, minlength=len(rows))
        g = (0.5 * (1 + np.tanh(z / 2)) - y) * weight
        for part, (text, cell, share) in enumerate(sides):
            model.weights[part] *= 1 - decay
            model.weights[part] -= 32 * np.bincount(cell, weights=g[text] * share, minlength=1 << BITS)
        model.bias -= g.sum()
    model.bias += float(np.log(base_rate / (1 - base_rate)))
    return model


#: Characters of hosts and paths that are scored at once.
_CHARS = 1 << 20


def _cuts(hosts: pd.Series, paths: pd.Series) -> Iterator[slice]:
    ends = (hosts.str.len() + paths.str.len()).cumsum().to_numpy()
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + _CHARS, side="right")))
        yield slice(start, stop)
        start = stop


def judged(pages: DataFrame, model: Model, columns: list[str], url_col: str = "url", rules=RULES) -> DataFrame:
    """``columns`` of ``pages`` with host, path, rule, verdict and block_score.

    A rule decides where one fits; else the model does, from a score of 0.5 on.
    A null URL, or one without "://", has an empty host and path and is judged
    by the model's intercept, that is allowed.  Repeated rows are judged alike,
    very long URLs are scored whole; an empty table gives an empty result, other
    columns are ignored.  ``rules`` and model are fixed parameters, sent to each
    executor once.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def block_score(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        scores = [shared.value.scores(hosts[cut].tolist(), paths[cut].tolist()) for cut in _cuts(hosts, paths)]
        return pd.Series(np.concatenate(scores) if scores else np.zeros(0))

    rows = pages.select(F.struct(*columns).alias("row"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = rows.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).withColumn("block_score", block_score("host", "path"))
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return rows.select("row.*", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "block_score")
