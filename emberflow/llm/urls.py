"""URL filters: pattern rules indexed by their rarest literal token (operator 5).

A rule has a name, a verdict and a regular expression over the url's host and path.  It is indexed under one of the
literal tokens that every matching url must hold: the one that is rarest among the urls at hand.  A url's tokens fetch
the candidate rules, and only these run their expressions.  Host rules (a host with its subdomains, and a path prefix)
take precedence and the longest wins; without one, the first pattern rule by name decides, and without that the
default.  Rules come as a list or from a table (:func:`rules_from`).  They are broadcast: their number doesn't grow with
the data, and a table of more than ``MOST_RULES`` is refused.  A task compiles only the expressions that it runs.

Results for odd input: a null url or one without "://" has an empty host and path, fits no host rule and gets the
default verdict; repeated rows are judged one by one; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules up to which a table is taken, as they are broadcast.
MOST_RULES = 200_000

_ASCII_LOWER = {i: i + 32 for i in range(65, 91)}
_TOKEN = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    pattern: str
    #: tokens that every matching url holds, in its host or path
    tokens: tuple[str, ...]
    #: host rules win over pattern rules, longer ones over shorter ones
    weight: int = 0


def host_rule(verdict: str, text: str) -> Rule:
    """A rule like "example.net/en/": the host and its subdomains, with paths that start with the rule's."""
    host, slash, rest = text.partition("/")
    host = host.translate(_ASCII_LOWER)
    path = slash + rest
    # the last token of the path counts only if the rule ends it
    inner = [m[0] for m in _TOKEN.finditer(path) if m.end() < len(path)]
    return Rule(text, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}\n{re.escape(path)}", (*_TOKEN.findall(host), *inner), 1 + len(text))


def word_rule(verdict: str, word: str) -> Rule:
    """A rule for a word, or words with signs between, that stands alone in the host or path; A-Z equal a-z."""
    word = word.translate(_ASCII_LOWER)
    inside = r"[0-9a-z\x80-\U0010ffff]"
    return Rule(f"*{word}*", verdict, rf"(?ai)(?<!{inside}){re.escape(word)}(?!{inside})", tuple(_TOKEN.findall(word)))


#: The base rules of the contract.
BASE_RULES = [host_rule("block", "net/"), host_rule("allow", "example.net/en/"), host_rule("block", "example.com/de/"), host_rule("allow", "org/fr/")]
#: Words of unwanted sites.
WORDS = ["casino", "gambling", "malware", "phishing", "porn", "torrent", "viagra", "warez", "xxx"]
PATTERN_RULES = [word_rule("block", w) for w in WORDS]


def rules_from(table: DataFrame, most: int = MOST_RULES) -> list[Rule]:
    """The rules of a table with columns kind ("host" or "word"), verdict and text; rows with a null go, repeated ones count once."""
    rows = table.select("kind", "verdict", "text").na.drop().distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    make = {"host": host_rule, "word": word_rule}
    return [make[r["kind"]](r["verdict"], r["text"]) for r in sorted(rows)]


def index_of(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """The rules under the rarest of their tokens, by the urls that hold each."""
    index: dict[str, list[Rule]] = {}
    for r in rules:
        index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(r)
    return index


def split(url: str | None) -> tuple[str, str]:
    """(host, path) of a url."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return host.translate(_ASCII_LOWER), path


def tokens(host: str, path: str) -> set[str]:
    """Tokens as written, and in lower case for rules that disregard it."""
    own = {*_TOKEN.findall(host), *_TOKEN.findall(path)}
    return own | {t.translate(_ASCII_LOWER) for t in own}


def judged(pages: DataFrame, rules: list[Rule] | None = None, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """Per page: host, path, the host rule that decided or null, the verdict, and the pattern rule or null."""
    rules = [*BASE_RULES, *PATTERN_RULES] if rules is None else rules
    if any(not r.tokens for r in rules):
        raise ValueError("a rule needs a literal token")
    slim = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    kind = dict(slim.dtypes)["page_id"]
    literal = sorted({t for r in rules for t in r.tokens})

    def count(batches):
        n = dict.fromkeys(literal, 0)
        for batch in batches:
            for text in batch.column("url").to_pylist():
                for t in tokens(*split(text)):
                    if t in n:
                        n[t] += 1
        yield pa.RecordBatch.from_pydict({"token": list(n), "n": pa.array(list(n.values()), pa.int64())})

    sums = dict(slim.select("url").mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n")).collect()) if literal else {}
    shared = pages.sparkSession.sparkContext.broadcast(index_of(rules, sums))

    def judge(batches):
        index = shared.value
        compiled = cache(re.compile)
        for batch in batches:
            out = []
            for text in batch.column("url").to_pylist():
                host, path = split(text)
                subject = f"{host}\n{path}"
                fits = [r for t in tokens(host, path) for r in index.get(t, ()) if compiled(r.pattern).search(subject)]
                best = min(fits, key=lambda r: (-r.weight, r.name), default=None)
                out.append((host, path, best.name if best and best.weight else None, best.verdict if best else default, best.name if best and not best.weight else None))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array(c, pa.string()) for c in columns)], names=["page_id", "host", "path", "rule", "verdict", "pattern"])

    return slim.mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string, pattern string")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SIGN = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]"
_HOST_CASES = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p in (("example.com", "/de/"), ("example.net", "/en/"), ("org", "/fr/"), ("net", "/")))
_WORD_CASES = " ".join(f"WHEN regexp_matches(translate(host || chr(10) || path, '{_UPPER}', '{_LOWER}'), '(^|{_SIGN}){w}({_SIGN}|$)') THEN '*{w}*'" for w in WORDS)
ORACLE = rf"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
p AS (SELECT page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT *, CASE {_HOST_CASES} END AS rule FROM p),
w AS (SELECT *, CASE WHEN rule IS NULL THEN CASE {_WORD_CASES} END END AS pattern FROM r)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern
FROM w
"""
