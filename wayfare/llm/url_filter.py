"""URL filters: exact host and path rules first, then a weighted vocabulary counted by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from wayfare.llm.common import ascii_lower

#: Terms of which one is enough.
STRICT_TERMS = (
    "adultcam", "bdsm", "camgirls", "casino", "casinos", "escort", "escorts", "hentai", "hardcore", "jackpot", "malware", "milf", "nude", "nudes", "phishing", "porn", "porno",
    "pornhub", "roulette", "sexcam", "sexshop", "slots", "torrent", "torrents", "viagra", "cialis", "warez", "webcamsex", "xvideos", "xxx",
)
#: Terms of which several distinct ones are needed.
SOFT_TERMS = (
    "adult", "bet", "bets", "betting", "bingo", "bonus", "cam", "cams", "cash", "cheap", "coupon", "crack", "credit", "dating", "deal", "deals", "diet", "discount", "drugs",
    "earn", "forex", "free", "gambling", "girls", "hot", "keygen", "loan", "loans", "lottery", "lucky", "meds", "money", "naked", "offer", "online", "payday", "pharmacy", "pill",
    "pills", "poker", "prize", "rich", "serial", "sex", "sexy", "singles", "spin", "teen", "weight", "win", "winner", "xx",
)
#: A url is rejected at this total; a strict term weighs as much alone.
REJECT_AT = 2


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty where there is no ://."""
    return ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits: its host or a subdomain of it, and a path that starts with the rule's. Null: none."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.text)).otherwise(out)
    return out


@lru_cache(maxsize=4)
def _automaton(terms: tuple[tuple[str, int], ...]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for i, (term, weight) in enumerate(terms):
        out.add_word(term, (i, len(term), weight))
    out.make_automaton()
    return out


def _inner(c: str) -> bool:
    return c.isascii() and c.isalnum()


def term_weight(url: str | None, terms: tuple[tuple[str, int], ...], enough: int) -> int:
    """Summed weights of the distinct terms that stand between boundaries (no ASCII letter or digit on either side), up to enough."""
    if not url:
        return 0
    low = url.lower() if url.isascii() else "".join(c.lower() if c.isascii() else c for c in url)
    seen, total, end = set(), 0, len(low)
    for last, (i, n, weight) in _automaton(terms).iter(low):
        first = last - n + 1
        if i in seen or (first and _inner(low[first - 1])) or (last + 1 < end and _inner(low[last + 1])):
            continue
        seen.add(i)
        total += weight
        if total >= enough:
            return enough
    return total


def vocabulary(strict=STRICT_TERMS, soft=SOFT_TERMS, enough: int = REJECT_AT) -> tuple[tuple[str, int], ...]:
    return tuple((t, enough) for t in strict) + tuple((t, 1) for t in soft)


def weigh(url: Column, strict=STRICT_TERMS, soft=SOFT_TERMS, enough: int = REJECT_AT) -> Column:
    terms = vocabulary(strict, soft, enough)

    @pandas_udf("int")
    def weights(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for urls in batches:
            yield pd.Series([term_weight(u, terms, enough) for u in urls], dtype="int32")

    return weights(url)


def judge(pages: DataFrame, rules: list[Rule], url: str = "url", page_id: str = "page_id", strict=STRICT_TERMS, soft=SOFT_TERMS, enough: int = REJECT_AT) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, term_weight.

    A null url, or one without ://, has an empty host and path and so no rule; a null url weighs 0 and is allowed.
    Repeated rows are judged one by one; an empty table gives no rows; other columns are ignored. No shuffle.
    """
    parted = pages.select(F.col(page_id).alias("page_id"), F.coalesce(host_of(F.col(url)), F.lit("")).alias("host"), F.coalesce(path_of(F.col(url)), F.lit("")).alias("path"), weigh(F.col(url), strict, soft, enough).alias("term_weight"))
    by_method = F.when(F.col("term_weight") >= enough, "block").otherwise("allow")
    verdict = by_method
    for r in rules:
        verdict = F.when(F.col("rule") == r.text, r.verdict).otherwise(verdict)
    return parted.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "term_weight")
