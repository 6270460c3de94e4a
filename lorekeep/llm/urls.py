"""URL filter: host and path rules first, then a weighted vocabulary.

Terms are found in the whole lower-cased URL with an Aho-Corasick automaton. A hit counts where no
ASCII letter or digit touches it. Each distinct term counts once with its weight; a URL whose weights reach the limit
is blocked. A strict term weighs the whole limit, soft terms weigh less, so one strict or several
distinct soft ones block.

Defined results: a NULL URL, or one without ``://``, has empty host and path and fits no rule; NULL
and empty URLs have no hits and are allowed. Repeated rows are judged alike, other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lorekeep.llm.tables import require

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

STRICT = ("adult", "casino", "escort", "gambling", "hentai", "malware", "phishing", "porn", "spam", "viagra", "warez", "xxx")
SOFT = (
    "ads", "bet", "bets", "betting", "bonus", "cheap", "click", "clickbait", "coupon", "dating", "deal", "discount",
    "farm", "free", "jackpot", "loan", "loans", "lottery", "nude", "pill", "pills", "poker", "prize", "replica",
    "sexy", "slots", "track", "tracker", "win", "winner",
)
SOFT_LIMIT = 2
VOCABULARY: dict[str, int] = dict.fromkeys(STRICT, SOFT_LIMIT) | dict.fromkeys(SOFT, 1)


@dataclass(frozen=True)
class Rule:
    """Allow or block a host with its subdomains below a path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def vocabulary_hits(urls: DataFrame, vocabulary: Mapping[str, int], limit: int) -> DataFrame:
    """``urls`` with ``strict_hits`` and ``soft_hits`` (distinct terms) and ``weight`` of column ``_url``."""
    if not vocabulary or any(not t or not t.isascii() or t != t.lower() for t in vocabulary):
        raise ValueError("terms must be lower-case ASCII and not empty")
    terms = dict(vocabulary)
    schema = T.StructType([*urls.schema.fields, *(T.StructField(c, T.IntegerType()) for c in ("strict_hits", "soft_hits", "weight"))])
    arrow = to_arrow_schema(schema)
    lower = str.maketrans(UPPER, LOWER)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for term in terms:
            automaton.add_word(term, term)
        automaton.make_automaton()
        for batch in batches:
            counts = np.zeros((3, batch.num_rows), np.int32)
            for i, url in enumerate(batch.column("_url").to_pylist()):
                text = (url or "").translate(lower)
                found = set()
                for last, term in automaton.iter(text):
                    before, after = text[last - len(term) : last - len(term) + 1] if last >= len(term) else "", text[last + 1 : last + 2]
                    if not ((before.isascii() and before.isalnum()) or (after.isascii() and after.isalnum())):
                        found.add(term)
                strict = sum(terms[t] >= limit for t in found)
                counts[:, i] = strict, len(found) - strict, sum(terms[t] for t in found)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, counts)], schema=arrow)

    return urls.mapInArrow(scan, schema)


def judge_urls(
    pages: DataFrame,
    url: str = "url",
    rules: Sequence[Rule] = (),
    vocabulary: Mapping[str, int] = VOCABULARY,
    limit: int = SOFT_LIMIT,
) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, strict_hits, soft_hits, weight``.

    The longest fitting rule decides (ties: the smaller text, then block); without one, the
    vocabulary does. Input columns of these names are replaced.
    """
    require(pages, url)
    added = ("host", "path", "rule", "verdict", "strict_hits", "soft_hits", "weight", "_url")
    kept = [c for c in pages.columns if c == url or c not in added]
    rows = vocabulary_hits(pages.select(*kept, F.col(url).alias("_url")), vocabulary, limit)
    host, path = host_and_path(F.col("_url"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("weight") >= limit, "block").otherwise("allow")
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text, r.verdict != "block"), reverse=True):
        fits = r.fits(F.col("host"), F.col("path"))
        rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rows.withColumn("rule", rule).withColumn("verdict", verdict).drop("_url")
