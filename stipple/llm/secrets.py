"""Secret scans over a trigram inverted index, with DataFrame functions only.

From every rule's expression a Boolean query over trigrams is derived: all
clauses must hold, a clause holds when all trigrams of one of its strings
occur.  The postings (trigram, row) of the trigrams that occur in a query are
intersected to candidate rows of each rule, and candidates are verified with
the expression itself.  A rule without mandatory trigrams scans every row.
"""

from __future__ import annotations

import re._constants as kind
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stipple.llm.spans import joined, match_spans

#: strings that one clause may list before it is closed
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A match counts when ``group`` of it (0: the whole) has at least ``least`` characters."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    ahead: str = ""  # a look-behind that changes no match but keeps the search linear


#: fixed values: the three base rules in their order, then rules of public token formats
RULES = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32, r"(?<![0-9a-f])"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[0-9A-Za-z_-]+", 0, 39),
    Rule("stripe", r"[rs]k_live_[0-9a-zA-Z]+", 0, 32),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("login", r"://[A-Za-z0-9._-]+:[^\x09-\x0D\x20:/@]+@", 0, 6),
]
BASE = 3


def _strings(items) -> set[str] | None:
    """Every string that the items match, or None where these are too many or unknown."""
    out = {""}
    for op, arg in items:
        more = _one(op, arg)
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _one(op, arg) -> set[str] | None:
    if op is kind.LITERAL:
        return {chr(arg).lower()}
    if op is kind.IN and all(o is kind.LITERAL for o, _ in arg):
        return {chr(a).lower() for _, a in arg}
    if op is kind.SUBPATTERN:
        return _strings(arg[3])
    if op is kind.BRANCH:
        parts = [_strings(p) for p in arg[1]]
        return None if None in parts else set().union(*parts)
    if op is kind.MAX_REPEAT and arg[1] == 1:
        inner = _strings(arg[2])
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    return None


def _clause(strings: set[str]) -> list[frozenset[str]] | None:
    """Alternative sets of trigrams, or None where a string is too short to have one."""
    if min(map(len, strings)) < 3:
        return None
    return sorted({frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}, key=sorted)


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Clauses that every text with a match fulfils (in lower case); none where the rule has no mandatory trigram."""
    clauses: list[list[frozenset[str]]] = []

    def close(strings: set[str]) -> None:
        if (c := _clause(strings)) is not None and c not in clauses:
            clauses.append(c)

    def scan(items) -> None:
        run = {""}
        for op, arg in items:
            more = _one(op, arg)
            if more is not None and len(run) * len(more) <= MOST_STRINGS:
                grown = {a + b for a in run for b in more}
                # an optional part would only weaken a clause that stands already
                if _clause(run) is not None and "" in more:
                    close(run)
                    run = {""}
                else:
                    run = grown
                continue
            close(run)
            run = {""} if more is None else more
            if op is kind.SUBPATTERN:
                scan(arg[3])
            elif op is kind.MAX_REPEAT and arg[0] > 0:
                scan(arg[2])
        close(run)

    scan(parser.parse(pattern))
    return clauses


def postings(docs: DataFrame, grams: list[str], text: str = "text") -> DataFrame:
    """gram, row: the rows (column ``row``) in whose text in lower case a gram occurs."""
    low = docs.select("row", F.lower(text).alias("low"))  # matches are ASCII, which stays ASCII and in place
    found = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    return low.select("row", F.explode(found).alias("gram")).distinct()


def candidates(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """row, rules: numbers of the rules whose trigram query the row fulfils; rules that scan fully are not listed."""
    spark = docs.sparkSession
    asked = [(r, c, b, g, len(grams)) for r, rule in enumerate(rules) for c, clause in enumerate(trigram_query(rule.pattern))
             for b, grams in enumerate(clause) for g in sorted(grams)]
    if not asked:
        return spark.createDataFrame([], "row bigint, rules array<int>")
    query = spark.createDataFrame(asked, "rule int, clause int, branch int, gram string, need int")
    clauses = query.groupBy("rule").agg(F.count_distinct("clause").alias("clauses"))
    held = postings(docs, sorted({g for *_, g, _ in asked}), text).join(F.broadcast(query), "gram")  # as long as the rules
    met = held.groupBy("row", "rule", "clause", "branch", "need").count().where(F.col("count") == F.col("need"))
    whole = met.groupBy("row", "rule").agg(F.count_distinct("clause").alias("n")).join(F.broadcast(clauses), "rule")
    return whole.where("n = clauses").groupBy("row").agg(F.collect_set("rule").alias("rules"))


def _found(text: Column, number: int, rule: Rule) -> Column:
    """Structs k, s, e of the rule's matches that are long enough."""
    spans = match_spans(text, rule.ahead + rule.pattern)
    if rule.group:
        group = F.regexp_extract_all(text, F.lit(rule.ahead + rule.pattern), F.lit(rule.group))
        size = F.transform(group, F.length)
        spans = F.filter(F.zip_with(spans, size, lambda x, n: F.struct(x["s"].alias("s"), x["e"].alias("e"), n.alias("n"))),
                         lambda x: x["n"] >= rule.least)
    else:
        spans = F.filter(spans, lambda x: x["e"] - x["s"] >= rule.least)
    return F.transform(spans, lambda x: F.struct(F.lit(number).alias("k"), x["s"].alias("s"), x["e"].alias("e")))


def scan(docs: DataFrame, rules: list[Rule] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, found: structs k (number of the rule), s, e of every match, for every row.

    A null text is an empty one; repeated rows are scanned each; rows with a
    null key are kept; other columns are left out; an empty table gives an
    empty one.  Places are code points of the whole text, the end exclusive.
    """
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text))
    rows = rows.withColumn("row", F.xxhash64(key, text))
    full = [n for n, r in enumerate(rules) if not trigram_query(r.pattern)]
    # equal rows share their number, and should two others do so, both are verified for the rules of either
    marked = rows.join(candidates(rows, rules, text), "row", "left")
    none = F.array().cast("array<struct<k:int,s:int,e:int>>")
    parts = []
    for n, rule in enumerate(rules):
        wanted = F.col(text).rlike(f"{rule.ahead}{rule.pattern[:-1]}{{{rule.least},}}") if n in full and rule.pattern.endswith("]+") \
            else F.lit(True) if n in full else F.coalesce(F.array_contains("rules", n), F.lit(False))
        parts.append(F.when(wanted, _found(F.col(text), n, rule)).otherwise(none))
    return marked.select(F.col(key), F.concat(*parts).alias("found"))


def report(found: DataFrame, rules: list[Rule] = RULES, key: str = "doc_id") -> DataFrame:
    """key, counts and digest of the base rules' spans, and all spans as text."""
    names = [r.name for r in rules]
    base = F.filter("found", lambda x: x["k"] < BASE)

    def count(n: int) -> Column:
        return F.size(F.filter("found", lambda x: x["k"] == n)).cast("bigint").alias(f"n_{names[n]}")

    return found.select(
        F.col(key), *map(count, range(BASE)),
        F.sha2(joined(base, names, True).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("found"), names, True).alias("spans"))


def report_sql(rules: list[Rule] = RULES) -> str:
    """The same rows in SQL: every rule scans every text."""
    def quoted(s: str) -> str:
        return s.replace("'", "''")

    def spans(n: int, r: Rule) -> str:
        p = quoted(r.pattern)
        size = f"regexp_extract_all(t, '{p}', {r.group})"
        return f"""SELECT doc_id, copy, {n} k, '{r.name}' kind, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: {{
  's': CAST(list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT),
  'l': length(m[i]), 'g': length(g[i])}}), lambda x: x.g >= {r.least})) x
FROM (SELECT doc_id, copy, regexp_extract_all(t, '{p}', 0) m, {size} g, string_split_regex(t, '{p}') b FROM docs)"""

    union = "\nUNION ALL\n".join(spans(n, r) for n, r in enumerate(rules))
    text = "string_agg(kind || ':' || x.s || ':' || (x.s + x.l), ',' ORDER BY x.s, k)"
    counts = ", ".join(f"count(x) FILTER (WHERE k = {n}) n_{rules[n].name}" for n in range(BASE))
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') t, row_number() OVER () copy FROM documents),
found AS ({union})
SELECT d.doc_id, {counts}, sha256(coalesce({text} FILTER (WHERE k < {BASE}), '')) base_sha256, coalesce({text}, '') spans
FROM docs d LEFT JOIN found f ON f.copy = d.copy GROUP BY d.doc_id, d.copy"""
