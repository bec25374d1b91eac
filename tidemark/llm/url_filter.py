"""URL filters: pattern rules indexed by their rarest literal token.

A rule is an action with a host and a path pattern (`*` stands for any text, in a host for any text without a
slash; no host stands for all). Its literal tokens are the labels of its host and the whole segments of its
path. Each rule is filed under the one of its tokens that the fewest URLs have, a rule without any under a token
that every URL has; a URL's tokens fetch candidate rules, and only those run as regular expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, with_seq

#: The index is broadcast up to this many rules (about 200 bytes each), else joined by shuffle.
BROADCAST_RULES = 50_000
#: The token of every URL that has a host or a path.
ANY = "*"


@dataclass(frozen=True)
class Rule:
    action: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))

    @property
    def path(self) -> str:
        return "".join(self.pattern.partition("/")[1:])

    def tokens(self) -> list[str]:
        """Host labels, and path segments that the pattern closes on both sides; ANY where there is none."""
        closed = self.path.split("/")[1:-1]
        return sorted({f"h:{x}" for x in self.host.split(".") if x and "*" not in x} | {f"p:{x}" for x in closed if x and "*" not in x}) or [ANY]

    def regex(self) -> str:
        """Over host and path together: the host or a subdomain, then the path's start."""
        quote = lambda s: re.sub(r"([^A-Za-z0-9_])", r"\\\1", s)
        host = r"(?:[^/]*\.)?" + "[^/]*".join(quote(x) for x in self.host.split("*")) if self.host else "[^/]*"
        return "(?s)^" + host + "(?:.*)".join(quote(x) for x in self.path.split("*"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: then up to `?`, `#` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_tokens(host: Column, path: Column, every: bool = False) -> Column:
    """Distinct tokens of a URL: its host's labels and its path's segments; with every, ANY beside them."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    out = F.array_distinct(F.concat(labels, F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))))
    return F.when((host != "") | (path != ""), F.concat(out, F.array(F.lit(ANY)))).otherwise(out) if every else out


def filter_urls(pages: DataFrame, rules: list[Rule], *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of pages: id_col, host, path, rule, verdict.

    The longest rule that fits decides (ties: the longer host, then the later in text order); without
    one, rule is null and the verdict is default. A null url or one without `://` has an empty host and
    path and fits no rule. Other columns are ignored, whatever their names; repeated rows are judged one by one;
    an empty table gives an empty result, and without rules all get the default.
    """
    spark = pages.sparkSession
    ranked = sorted(rules, key=lambda r: (len(r.pattern), len(r.host), r.pattern))
    urls = with_seq(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")), "seq")
    host, path = host_and_path(F.col("url"))
    urls = urls.select("seq", "id", host.alias("host"), path.alias("path"))
    every = any(r.tokens() == [ANY] for r in ranked)
    each = urls.select("*", F.explode(url_tokens(F.col("host"), F.col("path"), every)).alias("token"))
    known = spark.createDataFrame([(i, t) for i, r in enumerate(ranked) for t in r.tokens()], "rank int, token string")
    small = len(ranked) <= BROADCAST_RULES
    hint = F.broadcast if small else lambda x: x
    seen = each.join(hint(known.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    filed = known.join(hint(seen), "token", "left").groupBy("rank").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rarest"))
    text = spark.createDataFrame([(i, r.regex(), r.pattern, r.action) for i, r in enumerate(ranked)], "rank int, regex string, rule string, action string")
    index = filed.select("rank", F.col("rarest.token").alias("token")).join(hint(text.select("rank", "regex")), "rank")
    tried = each.join(hint(index), "token", "left")
    fits = F.rlike(F.concat("host", "path"), F.col("regex"))
    best = tried.groupBy("seq", "id", "host", "path").agg(F.max(F.when(fits, F.col("rank"))).alias("rank"))
    named = best.join(hint(text.select("rank", "rule", "action")), "rank", "left")
    return named.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))
