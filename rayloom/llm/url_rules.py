"""URL filter rules indexed by their rarest literal token.

A rule is a host, a path prefix and a verdict; it becomes one regular expression
over ``host + path``. Its literal tokens are the labels of the host and the
complete segments of the path. A URL can only match if it holds all of them, so
each rule is filed under the one of its tokens that the fewest URLs have. URLs
are cut into tokens, tokens fetch candidate rules, and only candidates run their
regular expression. The longest rule that fits wins.

An index of at most ``BROADCAST_RULES`` rules goes to every task as a dictionary
from token to rules, and pages are judged where they are, each distinct URL of a
batch once. A larger one is joined by token with the distinct URLs, and the
verdicts with salted pages.

Defined results for odd input: a URL that is null or has no ``://`` has an empty
host and path and fits no rule; ties between rules of equal length go to the
longer host, then to the larger text and verdict; repeated rows are judged alike;
an empty table or an empty rule list is fine; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

BROADCAST_RULES = 50_000


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


def host_of(url: str) -> Column:
    """From the first ``://`` to the next ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    rest = _after_scheme(url)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    """From the end of the host to the next ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: str) -> Column:
    at = F.coalesce(F.instr(F.col(url), "://"), F.lit(0))
    return F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise("")


def _pattern(rule: Rule) -> str:
    return r"(?s)^(?:[^/]*\.)?" + re.sub(r"([^0-9A-Za-z_])", r"\\\1", rule.host) + "(?![^/])" + re.sub(
        r"([^0-9A-Za-z_])", r"\\\1", rule.path
    )


def _rule_tokens(rule: Rule) -> list[str]:
    """Tokens that every fitting URL has; a path segment counts if slashes close it on both sides."""
    inner = rule.path.split("/")[1:-1] if rule.path.startswith("/") else []
    return sorted({f"h:{x}" for x in rule.host.split(".") if x} | {f"p:{x}" for x in inner if x}) or [""]


def url_tokens(host: str, path: str) -> Column:
    """Distinct tokens of a URL, and the empty one, under which rules without any literal stand."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(F.array(F.lit("")), labels, parts))


def rule_index(urls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(token, pattern, rule, verdict, ...): each rule under its rarest token in ``urls`` (host, path)."""
    spark = urls.sparkSession
    rows = [
        (i, token, _pattern(r), r.host + r.path, r.verdict, len(r.host) + len(r.path), len(r.host))
        for i, r in enumerate(rules)
        for token in _rule_tokens(r)
    ]
    schema = "rule_no int, token string, pattern string, rule string, verdict string, rule_length int, host_length int"
    listed = spark.createDataFrame(rows, schema)
    wanted = listed.select("token").distinct()
    counts = (
        urls.select(F.explode(url_tokens("host", "path")).alias("token"))
        .join(_maybe_broadcast(wanted, len(rows)), "token")
        .groupBy("token")
        .agg(F.count("*").alias("urls"))
    )
    rarest = listed.join(counts, "token", "left").groupBy("rule_no").agg(
        F.min_by(F.struct("token", "pattern", "rule", "verdict", "rule_length", "host_length"),
                 F.struct(F.coalesce("urls", F.lit(0)), "token")).alias("r")
    )
    return rarest.select("r.*")


def _maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_RULES else df


def judge_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", url_col: str = "url") -> DataFrame:
    """``pages`` (all its columns in a struct ``row``) with host, path, rule and verdict."""
    split = pages.select(F.struct("*").alias("row"), host_of(url_col).alias("host"), path_of(url_col).alias("path"))
    index = rule_index(split.select("host", "path"), rules)
    hits = _judge_in_tasks(split, index) if len(rules) <= BROADCAST_RULES else _judge_by_joins(split, index)
    return hits.select("row", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _judge_in_tasks(split: DataFrame, index: DataFrame) -> DataFrame:
    """(row, host, path, rule, verdict); the index is a dictionary from token to rules in every task."""
    shared = split.sparkSession.sparkContext.broadcast([tuple(r) for r in index.collect()])
    schema = StructType([*split.schema.fields, StructField("rule", StringType()), StructField("verdict", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filed: dict[str, list] = {}
        for token, pattern, rule, verdict, length, host_length in shared.value:
            filed.setdefault(token, []).append(((length, host_length, rule, verdict), re.compile(pattern)))

        def judge(host: str, path: str) -> tuple:
            tokens = {"", *(f"h:{x}" for x in host.split(".")), *(f"p:{x}" for x in path.split("/"))}
            url = host + path
            fits = [order for t in tokens if t in filed for order, pattern in filed[t] if pattern.match(url)]
            return max(fits)[2:] if fits else (None, None)

        for batch in batches:
            urls = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            known = {url: judge(*url) for url in set(urls)}
            found = [pa.array([known[url][i] for url in urls], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], ["row", "host", "path", "rule", "verdict"])

    return split.mapInArrow(run, schema)


def _judge_by_joins(split: DataFrame, index: DataFrame, salts: int = 64) -> DataFrame:
    """The same for an index that is too large to broadcast."""
    urls = split.select("host", "path").distinct()
    best = (
        urls.select("host", "path", F.explode(url_tokens("host", "path")).alias("token"))
        .join(index, "token")
        .filter(F.expr("concat(host, path) rlike pattern"))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("rule", "verdict"), F.struct("rule_length", "host_length", "rule", "verdict")).alias("hit"))
    )
    spread = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = split.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    return salted.join(spread, ["host", "path", "salt"], "left").select("row", "host", "path", "hit.rule", "hit.verdict")
