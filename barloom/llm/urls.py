"""URL filters: pattern rules indexed by their rarest literal token.

Every rule needs at least one literal token of its address (a run of letters and digits). Tokens
of all addresses are counted for the tokens that occur in rules, and each rule is filed under its
rarest token. A URL's tokens then fetch candidate rules by an equality join, and only those
candidates run their regular expression. Of the rules that match, the most specific (longest
text, then smallest text) decides; blocking wins between a host rule and none.

The rules are a parameter, so their number is known when the plan is made; the join has no
broadcast hint, so a large rule set is shuffled by token, and a token that a third of all
addresses share is split by the skew join (each address meets a rule once, so no group is
gathered). Everything is built-in expressions.

Defined cases: a null URL, or one without ``://``, has empty host and path, no rule and the
default verdict. Repeated rows each get their row. An empty rule set gives the default verdict.
"""
from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``name`` is reported, ``pattern`` runs on ``host + path``, ``literals`` are tokens that
    every match contains; ``order`` ranks kinds of rules, the smallest first."""
    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    order: int = 0


def address_rule(verdict: str, address: str) -> Rule:
    """A rule ``host/path`` fits the host and its subdomains where the path starts so."""
    host, slash, rest = address.partition("/")
    inside = rest.rpartition("/")[0] if not rest.endswith("/") else rest
    literals = tuple(re.findall(TOKEN, host)) + tuple(
        t for t in re.findall(TOKEN, inside.lower()) if t == t.lower() and t in inside)
    return Rule(address, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + rest)}",
                literals)


def pattern_rule(verdict: str, pattern: str, *literals: str) -> Rule:
    return Rule(pattern, verdict, pattern, literals, 1)


#: The given address rules, then the filter's own patterns.
RULES = (
    address_rule("block", "net/"),
    address_rule("allow", "example.net/en/"),
    address_rule("block", "example.com/de/"),
    address_rule("allow", "org/fr/"),
    pattern_rule("block", r"^(?:[^/]*\.)?spam-farm\.", "spam", "farm"),
    pattern_rule("block", r"^(?:[^/]*\.)?cheap-pills\.", "cheap", "pills"),
    pattern_rule("block", r"^[^/]*\bonline-casino\b", "online", "casino"),
    pattern_rule("block", r"^[^/]*\bfree-viagra\b", "free", "viagra"),
    pattern_rule("block", r"^(?:[^/]*\.)?(?:ads|adserver)\.[^/]*/banner/", "banner"),
)
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    end = r"(?s)[/?#].*$"
    host = F.translate(F.regexp_replace(rest, end, ""), _UPPER, _LOWER)
    path = F.regexp_replace(F.regexp_replace(rest, r"(?s)^[^/?#]*", ""), r"(?s)[?#].*$", "")
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _tokens(host: str, path: str) -> Column:
    lowered = F.translate(F.concat(host, F.lit(" "), path), _UPPER, _LOWER)
    return F.array_distinct(F.regexp_extract_all(lowered, F.lit(f"({TOKEN})"), F.lit(1)))


def judge(pages: DataFrame, key: str = "page_id", url: str = "url",
          rules: tuple[Rule, ...] = RULES, default: str = DEFAULT) -> DataFrame:
    """(key, host, path, rule, verdict, pattern): ``rule`` is the address rule that decided,
    ``pattern`` the pattern rule, both null where the default holds."""
    bare = [r.name for r in rules if not r.literals]
    if bare:
        raise ValueError(f"rules without a literal token: {bare}")
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("id"), host.alias("host"), path.alias("path"))
    book = spark.createDataFrame(
        [(i, r.name, r.verdict, r.pattern, list(r.literals), r.order) for i, r in enumerate(rules)],
        "no int, name string, verdict string, pattern string, literals array<string>, rank int")
    literals = book.select("no", F.explode("literals").alias("token"))
    # Repeated addresses are judged once.
    addresses = rows.select("host", "path").distinct()
    seen = addresses.select("host", "path", F.explode(_tokens("host", "path")).alias("token"))
    counted = (seen.join(literals.select("token").distinct(), "token", "left_semi")
               .groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    rarest = (literals.join(counted, "token", "left")
              .groupBy("no").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))
                                 .alias("best")))
    index = book.join(rarest, "no").select(
        F.col("best.token").alias("token"), "name", "verdict", "pattern", "rank")
    hits = seen.join(index, "token").where(
        F.expr("regexp_like(concat(host, path), pattern)"))
    place = F.struct("rank", (-F.length("name")).alias("size"), "name", "verdict")
    best = hits.groupBy("host", "path").agg(F.min(place).alias("best"))
    out = rows.join(best, ["host", "path"], "left")
    return out.select(
        F.col("id").alias(key), "host", "path",
        F.when(F.col("best.rank") == 0, F.col("best.name")).alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        F.when(F.col("best.rank") == 1, F.col("best.name")).alias("pattern"))


SQL = r"""
with p as (
  select page_id, case when strpos(url, '://') > 0
                       then substr(url, strpos(url, '://') + 3) end as rest from pages),
h as (
  select page_id,
    coalesce(translate(regexp_replace(rest, '[/?#][\s\S]*$', ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_replace(regexp_replace(rest, '^[^/?#]*', ''), '[?#][\s\S]*$', ''), '') as path
  from p),
r(name, verdict, host, path) as (values
  ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
  ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
m as (
  select h.page_id, r.name, r.verdict,
    row_number() over (partition by h.page_id order by length(r.name) desc, r.name) as k
  from h join r on (h.host = r.host or ends_with(h.host, '.' || r.host))
               and starts_with(h.path, r.path))
select h.page_id, h.host, h.path, m.name as rule,
  case when m.name is not null then m.verdict
       when regexp_matches(h.host, '(^|\.)(spam-farm|cheap-pills)\.')
         or regexp_matches(h.host || h.path,
              '^[^/]*\bonline-casino\b|^[^/]*\bfree-viagra\b|^([^/]*\.)?(ads|adserver)\.[^/]*/banner/')
       then 'block' else 'allow' end as verdict
from h left join m on m.page_id = h.page_id and m.k = 1
"""
