"""URL filter: host and path rules, then logistic regression on character n-grams.

Rules are exact and come first; the longest that fits decides.  Urls that no
rule fits are judged by a logistic regression on hashed character n-grams of
host and path.  The model is trained in the driver on a small labelled table (at
most ``MAX_LABELLED`` rows, a few hundred by default) and has ``FEATURES``
weights, so what is shipped to the tasks is of a fixed size.

Defined results: a null url and one without ``://`` have an empty host and path
and are judged by the model's intercept alone; repeated rows and null keys pass
through; of rules of equal length the first listed wins.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

FEATURES = 2**15
MAX_LABELLED = 10_000
SIZES = (3, 4, 5)
#: The least probability of block; see the README for what it gives on held-out words.
THRESHOLD = 0.5

#: Words that make the names in the default labelled table, by what makes a page unwanted.
BLOCKED_WORDS = (
    "casino poker bets betting bet365 jackpot slots slot-machine roulette blackjack bingo lotto lottery gambling wager bookmaker sportsbet baccarat "  # gambling
    "adult xxx porn porno sex sexcam sexy nude nudes escort escorts fetish hentai milf webcam-girls hookup erotic camgirls "  # adult
    "viagra cialis levitra pills pharmacy-cheap cheap-meds steroids diet-pills miracle-diet weight-loss-fast keto-gummies "  # remedies
    "free-money quick-loan payday payday-loan cash-advance get-rich crypto-giveaway double-bitcoin forex-signals binary-options "  # money
    "warez torrent torrents crack cracked keygen serials nulled pirate-movies free-downloads-full hack-tool cheats "  # piracy
    "replica-watch replica-bags fake-id cheap-luxury knockoff "  # counterfeits
    "click-ads ads ads-tracker ads-track adserver adclick popads banner-ads track tracker tracking pixel-track affiliate-link "  # advertising
    "spam spammer phishing malware trojan scam lottery-win you-won prize-winner free-iphone win-prize account-verify secure-login-update"  # fraud
).split()
ALLOWED_WORDS = (
    "news daily times herald tribune journal library school academy college campus museum science physics chemistry biology history archive "
    "garden flowers recipes cooking bakery kitchen weather travel railway airport hotel music concert orchestra sports football tennis athletics "
    "health-center hospital clinic dental university research research-lab institute market forum photos gallery theater cinema city-hall council "
    "government parliament press books reading poetry maps atlas engineering software database opensource linux python-docs wiki encyclopedia "
    "dictionary translate radio television podcast charity church community parents kids toys pets dogs cats birds farming forest river mountain "
    "energy solar bank insurance law court tax jobs career housing architecture design furniture bicycle cars motor repair essex sussex "
    "middlesex scunthorpe adulteducation betterment alphabet diabetes trackandfield loadstone shadow leads crackers slotcar"
).split()
#: Frequent letter groups of English, of which names without a meaning are made.
SYLLABLES = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le".split()
SEED_PATHS = ("/", "/en/12", "/de/304.html", "/fr/77", "/articles/2020/index.html", "/about", "/es/5")


def default_labels() -> list[tuple[str, bool]]:
    """The default table: urls and whether to block them, made by rule from word lists.

    Each word stands alone and with prefixes and endings that both labels share; names
    without a meaning are allowed.  Hosts and paths are dealt to both labels in turn, so
    that only the names tell.  :func:`word_of` gives the word of an url, by which the table
    can be split without a word on both sides.
    """
    forms = ("{}", "{}-win", "best-{}", "{}-x", "free-{}", "my{}", "{}online", "{}24")
    names = [(f.format(w), label) for words, label in ((BLOCKED_WORDS, True), (ALLOWED_WORDS, False)) for w in words for f in forms]
    n = len(SYLLABLES)
    names += [(SYLLABLES[k % n] + SYLLABLES[(7 * k + k // n) % n] + SYLLABLES[(11 * k + k // 3) % n] * (k % 3 > 0), False) for k in range(30 * n)]
    out = []
    for label in (True, False):
        for k, name in enumerate(x for x, b in names if b == label):
            host = ("", "www.", "m.", "blog.")[k % 4] + name + (".example.com", ".example.net", ".example.org", ".info", ".com")[k % 5]
            out.append((f"https://{host}{SEED_PATHS[k % 7]}", label))
    return out


def word_of(url: str) -> str:
    """The longest listed word in the host of an url of the default table, or its whole name."""
    name = url.split("/")[2]
    found = [w for w in (*BLOCKED_WORDS, *ALLOWED_WORDS) if w in name]
    return max(found, key=len) if found else name


def url_parts(url):
    """Host (A-Z lower-cased) and path of a url column, both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("`_url`")))
    host = F.coalesce(ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.lit(""))
    return host, F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def features(host: str, path: str) -> np.ndarray:
    """The distinct hashed n-grams of both, with marks for the ends."""
    out = []
    for mark, s in ((b"h", host), (b"p", path)):
        if not s:
            continue
        b = b"^" + s.encode("utf-8") + b"$"
        for n in SIZES:
            out += [zlib.crc32(mark + b[i : i + n]) % FEATURES for i in range(len(b) - n + 1)]
    return np.unique(np.array(out, np.int64))


def train(labels: list[tuple[str, str, bool]], steps: int = 300, rate: float = 40.0, penalty: float = 3e-6) -> tuple[np.ndarray, float]:
    """Weights and intercept from rows of host, path and label, by gradient descent from zero; both labels have the same weight in all."""
    if len(labels) > MAX_LABELLED:
        raise ValueError(f"the labelled table has more than {MAX_LABELLED} rows")
    found = [features(h, p) for h, p, _ in labels]
    row = np.repeat(np.arange(len(found)), [len(f) for f in found])
    col = np.concatenate([*found, np.empty(0, np.int64)])
    value = 1 / np.sqrt(np.array([max(1, len(f)) for f in found]))[row]
    y = np.array([float(b) for *_, b in labels])
    share = np.where(y == 1, 1 / max(1, y.sum()), 1 / max(1, (1 - y).sum())) / 2
    w, bias = np.zeros(FEATURES), 0.0
    for _ in range(steps if len(y) else 0):
        z = np.bincount(row, value * w[col], len(y)) + bias
        error = (1 / (1 + np.exp(-z)) - y) * share
        w -= rate * (np.bincount(col, value * error[row], FEATURES) + penalty * w)
        bias -= rate / 10 * error.sum()
    return w.astype("float32"), float(bias)


def judge(pages: DataFrame, rules: list[tuple[str, str]], labels: DataFrame | None = None, key: str = "page_id", url: str = "url", threshold: float = THRESHOLD) -> DataFrame:
    """``key, host, path, rule, verdict, score`` of every row.

    ``rules``: pairs of verdict (allow or block) and ``host/path`` prefix.
    ``labels``: rows of ``url string, blocked boolean``, at most ``MAX_LABELLED``
    (more is an error); by default :func:`default_labels`.  ``score`` is the
    model's probability of block, null where a rule decides.
    """
    spark = pages.sparkSession
    labels = labels if labels is not None else spark.createDataFrame(default_labels(), "url string, blocked boolean")
    host, path = url_parts(F.col("_url"))
    known = [(r.h, r.p, r.b) for r in labels.select(F.col("url").alias("_url"), F.col("blocked").alias("b")).filter("b is not null").select(host.alias("h"), path.alias("p"), "b").limit(MAX_LABELLED + 1).collect()]
    weights, bias = train(sorted(known))

    shared = spark.sparkContext.broadcast((weights, bias))

    @F.arrow_udf("double")
    def score(hosts, paths):
        w, b = shared.value
        out = []
        for h, p in zip(hosts.to_pylist(), paths.to_pylist(), strict=True):
            found = None if h is None else features(h, p)
            out.append(None if found is None else float(1 / (1 + np.exp(-(w[found].sum() / np.sqrt(max(1, len(found))) + b)))))
        return pa.array(out, pa.float64())

    fits = F.lit(None).cast("string")
    said = F.lit(None).cast("string")
    for said_by, rule in sorted(reversed(rules), key=lambda r: len(r[1])):  # the longest is outermost, of equals the first
        rule_host, _, rule_path = rule.partition("/")
        fit = ((F.col("host") == rule_host) | F.col("host").endswith("." + rule_host)) & F.col("path").startswith("/" + rule_path)
        fits, said = F.when(fit, rule).otherwise(fits), F.when(fit, said_by).otherwise(said)
    parts = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url")).select("_key", host.alias("host"), path.alias("path"))
    ruled = parts.withColumns({"rule": fits, "_said": said})
    # a host that a rule decides goes to the model as null, which costs nothing there
    free = ruled.withColumn("score", score(F.when(F.col("rule").isNull(), F.col("host")), F.col("path")))
    verdict = F.coalesce("_said", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return free.select(F.col("_key").alias(key), "host", "path", "rule", verdict.alias("verdict"), "score")
