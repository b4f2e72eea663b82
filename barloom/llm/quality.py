"""Quality rules with risk-controlled thresholds, in built-in expressions only.

Each rule rejects a text whose measure exceeds a cutoff. Cutoffs are chosen on labelled
documents: per stratum (language), cutoffs are tested from the loosest to the strictest, and the
strictest is taken such that this and all looser ones reject good documents at a rate below the
limit with confidence: P(Binomial(n, limit) <= k) <= error / tests, where n good documents are
labelled and k of them would be rejected (the exact Clopper-Pearson bound). The rules share one
scale, so their cutoffs move together: a document is rejected if any of its measures exceeds the
cutoff, and one nested sequence of joint cutoffs is tested at the whole ``LIMIT``. A fixed test
order needs no correction inside a stratum; ``error`` is divided by the number of strata
(Bonferroni). A limit of 4 % with four strata needs 108 good labels in a stratum.

A trial is a labelled document, once, however often its row or its text is repeated: the bound
holds for independent documents.

One pass over the texts makes a narrow table; thresholds are one aggregate over the labelled
rows of it. A stratum that holds a third of all rows is counted in map-side steps; thresholds
are one row for each stratum, joined without a hint.

Defined cases: a null text has no words and fails. A stratum without enough labels gets no
cutoff and rejects nothing beyond the base. Conflicting labels of one document count as bad;
null labels do not count. Repeated rows get equal results. Of a labelled document with several
rows, and of good documents with one text, the greatest measure is one trial.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.plans.storage import cut

LIMIT = 0.04
ERROR = 0.05
WINDOW = 8
#: Cutoffs from the loosest to the strictest, the same for every measure.
CUTOFFS = (2.0, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.075, 0.05, 0.025, 0.01)
MEASURES = {
    "symbols": "n_symbols / cast(n_words as double)",
    "dup_lines": "n_dup_lines / cast(n_lines as double)",
    "repeats": "n_repeat_words / cast(n_words as double)",
    "long_words": "greatest(word_chars / cast(n_words as double) - 8.0, 0.0) / 8.0",
}


def _without(text: str, chars: str) -> str:
    for c in chars:
        text = f"replace({text}, '{c}', '')"
    return text


def counts(docs: DataFrame, keep: dict[str, str], text: str = "text") -> DataFrame:
    """Whole-text counts: words and their code points, symbols, repeated lines, words in
    repeated 8-word windows. ``keep``: output name -> input column."""
    t = docs.select(*[F.col(c).alias(k) for k, c in keep.items()],
                    F.coalesce(F.col(text), F.lit("")).alias("t_"))
    blank = r" \t\n\u000B\u000C\r"
    spaces = "length(t_) - length(" + _without("t_", [
        " ", "\\t", "\\n", "\\u000B", "\\u000C", "\\r"]) + ")"
    t = t.select(
        *keep,
        F.expr(f"filter(split(t_, '[{blank}]+'), x -> x != '')").alias("w_"),
        F.expr(f"filter(split(t_, '\\n', -1), x -> x rlike '[^{blank}]')").alias("l_"),
        F.expr(f"cast(length(t_) - ({spaces}) as long)").alias("word_chars"),
        F.expr("cast(length(t_) - length(" + _without("t_", "#*$%&|<>") + ") as long)")
        .alias("n_symbols"))
    t = t.select(
        *keep, "word_chars", "n_symbols",
        F.size("w_").cast("long").alias("n_words"), F.size("l_").cast("long").alias("n_lines"),
        (F.size("l_") - F.size(F.array_distinct("l_"))).cast("long").alias("n_dup_lines"),
        F.expr("transform(w_, x -> xxhash64(x))").alias("h_"))
    cells = ", ".join(f"h_[i + {j}]" for j in range(WINDOW))
    t = t.withColumn("g_", F.expr(
        f"case when n_words < {WINDOW} then array() else transform("
        f"sequence(0, cast(n_words as int) - {WINDOW}), i -> xxhash64({cells})) end"))
    t = t.withColumn("again_", F.size("g_") > F.size(F.array_distinct("g_")))
    # Only texts with a repeated window sort their windows and add up what they cover.
    t = t.withColumn("s_", F.expr(
        "case when again_ then array_sort(transform(g_, (x, i) -> struct(x as x, i as i))) end"))
    t = t.withColumn("p_", F.expr(
        "case when again_ then array_sort(transform(filter(transform(s_, (e, j) -> struct(e.i as i,"
        " (j > 0 and s_[j - 1].x = e.x) or (j < size(s_) - 1 and s_[j + 1].x = e.x) as hit)),"
        " e -> e.hit), e -> e.i)) end"))
    covered = F.expr(
        f"case when again_ then aggregate(transform(p_, (x, j) -> case when j = size(p_) - 1 then"
        f" {WINDOW} else least({WINDOW}, p_[j + 1] - x) end), 0L, (a, x) -> a + x) else 0L end")
    return t.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines",
                    covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def log_cdf(n: Column, k: Column, p: float) -> Column:
    """Natural logarithm of P(Binomial(n, p) <= k) for k < n p, added up from the largest
    term downwards, so nothing underflows."""
    odds = math.log(p / (1 - p))
    top = F.aggregate(F.sequence(F.lit(0), k.cast("int")), F.lit(0.0), lambda a, i: a + F.when(
        i > 0, F.log((n - i + 1) / i.cast("double")) + odds).otherwise(0.0))
    below = F.aggregate(
        F.sequence(F.lit(0), k.cast("int")), F.struct(F.lit(1.0).alias("term"),
                                                      F.lit(0.0).alias("total")),
        lambda a, j: F.struct(
            (a["term"] * (k - j) / (n - k + j + 1) * ((1 - p) / p)).alias("term"),
            (a["total"] + a["term"]).alias("total")), lambda a: a["total"])
    return top + n * math.log(1 - p) + F.log(below)


def thresholds(rows: DataFrame, limit: float = LIMIT, error: float = ERROR,
               rules: int = len(MEASURES)) -> DataFrame:
    """(stratum, cuts): the cutoff of every rule that may reject. ``rows`` are good documents
    with their measures: (stratum, measures map). ``limit`` and ``error`` are divided among
    ``rules`` that are tested apart."""
    share = limit / rules
    cutoffs = F.array(*[F.lit(c) for c in CUTOFFS])
    bins = rows.select("stratum", F.explode("measures").alias("rule", "value")).select(
        "stratum", "rule", F.size(F.filter(cutoffs, lambda c: F.col("value") <= c)).alias("bin"))
    found = bins.groupBy("stratum", "rule", "bin").agg(F.count(F.lit(1)).alias("n"))
    per = found.groupBy("stratum", "rule").agg(
        F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("at"))
    # k at cutoff i: documents whose measure exceeds it fall in bins up to i.
    steps = per.select("stratum", "rule", "n", F.posexplode(cutoffs).alias("i", "cutoff"), "at")
    k = F.aggregate(F.sequence(F.lit(0), F.col("i")), F.lit(0).cast("long"),
                    lambda a, j: a + F.coalesce(F.col("at")[j], F.lit(0).cast("long")))
    strata = steps.select("stratum", "rule", "n", "i", "cutoff", k.alias("k"))
    tests = rows.select("stratum").distinct().agg(F.count(F.lit(1)).alias("strata"))
    strata = strata.join(F.broadcast(tests))  # one row
    passes = F.when(F.col("k") < F.col("n") * share, log_cdf(F.col("n"), F.col("k"), share)
                    <= F.log(F.lit(error) / (F.col("strata") * rules))).otherwise(False)
    return (strata.withColumn("fails", (~passes).cast("int"))
            .withColumn("failed", F.sum("fails").over(
                Window.partitionBy("stratum", "rule").orderBy("i")))
            .where("failed = 0").groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))
            .groupBy("stratum").agg(F.map_from_entries(F.collect_list(
                F.struct("rule", "cutoff"))).alias("cuts")))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
          stratum: str = "lang", limit: float = LIMIT, error: float = ERROR) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` for every row."""
    t = cut(counts(docs.withColumn("h_0", F.xxhash64(F.col(text))),
                   {"k": key, "s_0": stratum, "copy": "h_0"}, text)
            .withColumn("base_failed", base_failed())
            .withColumn("stratum", F.coalesce(F.col("s_0").cast("string"), F.lit("")))
            .withColumn("worst", F.when(~F.col("base_failed"), F.greatest(
                *[F.expr(e) for e in MEASURES.values()]))))
    good = (labels.where("doc_id is not null and quality is not null").groupBy("doc_id")
            .agg(F.min("quality").alias("q")).where("q = 1"))
    trials = (t.where("not base_failed").join(good, F.col("k") == F.col("doc_id"))
              .groupBy("doc_id").agg(F.min("stratum").alias("stratum"), F.min("copy").alias("copy"),
                                     F.max("worst").alias("worst"))
              .groupBy("stratum", "copy").agg(F.max("worst").alias("worst")))
    cuts = thresholds(trials.select("stratum", F.create_map(F.lit("any"), "worst").alias(
        "measures")), limit, error, 1).select("stratum", F.col("cuts")["any"].alias("most"))
    exceeded = F.coalesce(F.col("worst") > F.col("most"), F.lit(False))
    return t.join(cuts, "stratum", "left").select(
        F.col("k").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed",
        F.when(F.col("base_failed"), False).otherwise(~exceeded).alias("kept"))


SQL = r"""
with recursive d as (
  select doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as t from documents),
w as (
  select row_number() over () as rid, doc_id, stratum, t,
    list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from d),
g as (
  select rid, i, count(*) over (partition by rid, win) as c from (
    select rid, i, array_to_string(words[i:i + 7], ' ') as win
    from (select rid, words, unnest(range(1, len(words) - 6)) as i from w))),
p as (
  select rid, least(8, coalesce(lead(i) over (partition by rid order by i) - i, 8)) as n
  from g where c > 1),
r as (select rid, sum(n) as n_repeat_words from p group by rid),
b as (
  select doc_id, stratum, t, cast(len(words) as bigint) as n_words,
    cast(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as bigint) as word_chars,
    cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
    len(lines) as n_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words
  from w left join r using (rid)),
f as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from b),
m as (
  select *, greatest(n_symbols / cast(n_words as double), n_dup_lines / cast(n_lines as double),
    n_repeat_words / cast(n_words as double),
    greatest(word_chars / cast(n_words as double) - 8.0, 0.0) / 8.0) as worst from f),
good as (select doc_id from labels where doc_id is not null and quality is not null
         group by doc_id having min(quality) = 1),
held as (
  select stratum, max(v) as v from (
    select doc_id, min(stratum) as stratum, min(t) as t, max(worst) as v
    from m join good using (doc_id) where not base_failed group by doc_id) group by stratum, t),
c(i, cutoff) as (values {cutoffs}),
k as (
  select stratum, i, cutoff, count(*) as n, count(*) filter (v > cutoff) as k
  from held cross join c group by all),
z as (
  select *, k < n * {share} and (
      select ln(sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)
                        + j * ln({share}) + (n - j) * ln(1 - {share}))))
      from unnest(range(0, k + 1)) as u(j))
    <= ln({error} / (select count(distinct stratum) from held)) as ok from k),
cuts as (
  select stratum, min(cutoff) as most from (
    select *, sum(case when ok then 0 else 1 end)
      over (partition by stratum order by i) as failed from z)
  where failed = 0 group by all)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  case when base_failed then false else not coalesce(worst > most, false) end as kept
from m left join cuts using (stratum)
""".replace("{cutoffs}", ", ".join(f"({i}, {c}::double)" for i, c in enumerate(CUTOFFS))) \
   .replace("{share}", repr(LIMIT)).replace("{error}", repr(ERROR)) \
   .replace("with recursive", "with")
