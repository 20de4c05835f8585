"""URL verdicts by pattern rules that are indexed by their rarest literal token.

A rule is `(rule, pattern, verdict, tier)`. Its pattern speaks about the subject of a url: the host, A-Z in lower case, followed by all that
follows it. Signs of a pattern: `||` at its start is the start of the host or of one of its labels, `|` at the start or the end is that of the
subject, `*` any run of characters, `@` any run inside the host, `^` the edge of a token (a run of letters a-z and digits, either case), `<re>` a
regular expression; all else stands for itself. Of the rules that match, the highest tier wins, then the longest pattern, then the smallest name.

A literal run that the pattern closes on both sides is a token that every matching url holds. Of a rule's tokens the one found in the
fewest urls is its key: a url's tokens fetch the rules under them, and only those run their expressions. Rules without such a token run
on every url. Up to `MAX_RULES` rules travel to the tasks; more are joined to the urls' tokens (`attach`, so that hot tokens are spread).

A null url, or one without `://`, has an empty host, path and subject, and only an empty pattern could match it: the verdict is
`default`. Very long urls are read whole. Repeated urls get equal verdicts, row by row; no row is joined on its id, so null and repeated ids
do no harm. An empty table gives an empty one, and without rules every url has the default. Other columns of the input stay untouched
in `keep_allowed` and are not in the way in `url_verdicts`, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from minim.llm.texts import small_batches
from minim.operators.keyed import attach

#: Rules that are sent to the tasks as they are; beyond it they are joined.
MAX_RULES = 20_000
RULE = "rule string, pattern string, verdict string, tier int"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SIGNS = re.compile(r"\|\||\||\*|@|\^|<[^>]*>|[A-Za-z0-9]+|.", re.DOTALL)
_TOKEN = re.compile(r"[a-z0-9]+")
_TO_LOWER = str.maketrans(_UPPER, _LOWER)


def host_of(url: str = "url") -> Column:
    """What stands between the first `://` and the next `/`, `?`, `#` or the end, A-Z in lower case; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: str = "url") -> Column:
    """What stands between the host and the next `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "://[^/?#]*([^?#]*)", 1)


def subject_of(url: str = "url") -> Column:
    """Host and all that follows it."""
    return F.concat(host_of(url), F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "://[^/?#]*((?s).*)", 1))


def compile_rule(pattern: str) -> tuple[str, list[str]]:
    """The pattern's regular expression, to be searched in a subject, and the tokens that every match holds."""
    # A run of any characters at an end says nothing, and would make a failing search quadratic.
    parts = _SIGNS.findall(pattern.strip("*"))
    out, tokens = [], set()
    for i, part in enumerate(parts):
        if part == "||" and i == 0:
            # `@` takes in all labels before.
            out.append(r"\A" if parts[1:2] == ["@"] else r"\A(?:[^/?#]*\.)?")
        elif part == "|" and i in (0, len(parts) - 1):
            out.append(r"\A" if i == 0 else r"\Z")
        elif part == "*":
            out.append(r"[\s\S]*")
        elif part == "@":
            out.append(r"[^/?#]*")
        elif part == "^":
            out.append(r"(?:(?<![A-Za-z0-9])|(?![A-Za-z0-9]))")
        elif len(part) > 1 and part[0] == "<":
            out.append(f"(?:{part[1:-1]})")
        else:
            out.append(re.escape(part))
            if part.isascii() and part.isalnum():
                closed = [i > 0 and _closes(parts, i - 1), i + 1 < len(parts) and _closes(parts, i + 1)]
                if all(closed):
                    tokens.add(part.translate(_TO_LOWER))
    return "".join(out), sorted(tokens)


def _closes(parts: Sequence[str], i: int) -> bool:
    """Whether a part next to a run of letters and digits is sure to end the token there."""
    part = parts[i]
    if part in ("*", "@") or (len(part) > 1 and part[0] == "<"):
        return False
    return True


def order_of(rule) -> tuple:
    """Smaller is stronger."""
    return (-rule["tier"], -len(rule["pattern"]), rule["rule"])


class RuleIndex:
    """Rules by their rarest token, strongest first; `open` rules have no token."""

    def __init__(self, rules: Sequence[dict], seen: dict[str, int]):
        self.by_token: dict[str, list[tuple]] = {}
        self.open: list[tuple] = []
        for r in sorted(rules, key=order_of):
            regex, tokens = compile_rule(r["pattern"])
            entry = (order_of(r), re.compile(regex), r["rule"], r["pattern"], r["verdict"], r["tier"])
            if tokens:
                self.by_token.setdefault(min(tokens, key=lambda t: (seen.get(t, 0), t)), []).append(entry)
            else:
                self.open.append(entry)

    def __getstate__(self):
        return {"by_token": {t: [(e[0], e[1].pattern, *e[2:]) for e in v] for t, v in self.by_token.items()},
                "open": [(e[0], e[1].pattern, *e[2:]) for e in self.open]}

    def __setstate__(self, state):
        again = {p: re.compile(p) for v in [*state["by_token"].values(), state["open"]] for _, p, *_ in v}
        self.by_token = {t: [(e[0], again[e[1]], *e[2:]) for e in v] for t, v in state["by_token"].items()}
        self.open = [(e[0], again[e[1]], *e[2:]) for e in state["open"]]

    def candidates(self, subject: str) -> Iterator[list[tuple]]:
        """Lists of rules that can match."""
        for token in set(_TOKEN.findall(subject.translate(_TO_LOWER))):
            if token in self.by_token:
                yield self.by_token[token]
        yield self.open

    def judge(self, subject: str) -> tuple | None:
        """`(rule, pattern, verdict, tier)` of the strongest rule that matches."""
        best = None
        for rules in self.candidates(subject):
            for entry in rules:
                if best is not None and entry[0] >= best[0]:
                    break
                if entry[1].search(subject):
                    best = entry
                    break
        return best and best[2:]


def _tokens(subject: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(subject, _UPPER, _LOWER), F.lit("([a-z0-9]+)"), 1))


def token_counts(pages: DataFrame, tokens: DataFrame, url: str = "url") -> DataFrame:
    """`(token, n)`: in how many rows of `pages` each of the `tokens` occurs."""
    held = pages.select(F.explode(_tokens(subject_of(url))).alias("token"))
    return held.join(tokens, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def build_index(spark: SparkSession, pages: DataFrame, rules: Sequence[dict], url: str = "url") -> RuleIndex:
    """The index of at most `MAX_RULES` rules, by token counts over all urls."""
    wanted = sorted({t for r in rules for t in compile_rule(r["pattern"])[1]})
    seen = {}
    if wanted:
        # A rule of n characters has at most n / 2 tokens: the list and the counts are bounded by the rules.
        table = spark.createDataFrame([(t,) for t in wanted], "token string")
        seen = {r["token"]: r["n"] for r in token_counts(pages, F.broadcast(table), url).collect()}
    return RuleIndex(rules, seen)


def _judged(spark: SparkSession, index: RuleIndex):
    """A column function from a subject to the strongest matching rule."""
    shared = spark.sparkContext.broadcast(index)

    @F.pandas_udf(RULE)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        rules = shared.value
        for batch in batches:
            found = [rules.judge(s) or (None, None, None, None) for s in batch]
            out = pd.DataFrame(found, columns=["rule", "pattern", "verdict", "tier"])
            yield out.astype({"tier": "Int32"})

    return judge


def _joined(pages: DataFrame, rules: DataFrame, url: str) -> DataFrame:
    """`(subject, found)`: the strongest rule of each distinct subject, where the rules are too many to send along."""
    spark = pages.sparkSession

    def compiled(batches):
        for batch in batches:
            made = [compile_rule(p) for p in batch["pattern"]]
            yield batch.assign(regex=[m[0] for m in made], tokens=[m[1] for m in made])

    named = rules.select("rule", "pattern", "verdict", "tier").mapInPandas(compiled, RULE + ", regex string, tokens array<string>")
    subjects = pages.groupBy(subject_of(url).alias("subject")).agg(F.count(F.lit(1)).alias("pages"))
    counts = token_counts(pages, named.select(F.explode("tokens").alias("token")).distinct(), url)
    # The rarest token of each rule; a token in no url needs no rule under it.
    keyed = named.select("rule", "pattern", "verdict", "tier", "regex", F.explode("tokens").alias("token"))
    keyed = keyed.join(counts, "token", "left")
    rare = keyed.groupBy("rule", "pattern", "verdict", "tier", "regex").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("key")).where("key.n > 0")
    lists = rare.groupBy(F.col("key.token").alias("token"), F.pmod(F.xxhash64("rule", "pattern"), F.lit(1 << 16)).alias("part")).agg(
        F.collect_list(F.struct("rule", "pattern", "verdict", "tier", "regex")).alias("rules"), F.max("key.n").alias("n"))
    parts = lists.groupBy("token").agg(F.collect_list("part").alias("parts"), F.max("n").alias("n"))
    wide = attach(subjects.select("subject", F.explode(_tokens(F.col("subject"))).alias("token")), parts, ["token"], "n", how="inner")
    asked = attach(wide.select("subject", "token", F.explode("parts").alias("part")), lists, ["token", "part"], "n", how="inner")
    # Rules without a token meet every subject, a list of at most MAX_RULES at a time.
    pairs = asked.select("subject", F.explode("rules").alias("r")).select("subject", "r.*")

    def matching(batches):
        known: dict[str, re.Pattern] = {}
        for batch in batches:
            hit = []
            for regex, subject in zip(batch["regex"], batch["subject"]):
                if regex not in known:
                    if len(known) >= MAX_RULES:
                        known.clear()
                    known[regex] = re.compile(regex)
                hit.append(known[regex].search(subject) is not None)
            yield batch[hit]

    schema = "subject string, rule string, pattern string, verdict string, tier int, regex string"
    hits = pairs.mapInPandas(matching, schema).drop("regex")
    free = named.where(F.size("tokens") == 0).select("rule", "pattern", "verdict", "tier")
    block: list[dict] = []

    def against(block: Sequence[dict]) -> DataFrame:
        judge = _judged(spark, RuleIndex(block, {}))
        return subjects.select("subject", judge("subject").alias("r")).where("r.rule IS NOT NULL").select("subject", "r.*")

    for r in free.toLocalIterator():
        block.append(r.asDict())
        if len(block) == MAX_RULES:
            hits, block = hits.unionByName(against(block)), []
    if block:
        hits = hits.unionByName(against(block))
    found = F.struct("rule", "pattern", "verdict", "tier")
    best = hits.groupBy("subject").agg(F.min_by(found, F.struct(-F.col("tier"), -F.length("pattern"), F.col("rule"))).alias("found"))
    return best.join(subjects, "subject").select("subject", "found", "pages")


def with_verdicts(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """`(row, subject, found)`: each row of `pages` as a struct, its subject, and `(rule, pattern, verdict, tier)` or null."""
    spark = pages.sparkSession
    small_batches(spark, 2000)
    row = F.struct(*[pages[c] for c in pages.columns]).alias("row")
    rows = pages.select(row, subject_of(url).alias("subject"))
    few = rules.select("rule", "pattern", "verdict", "tier").limit(MAX_RULES + 1).collect()
    if len(few) <= MAX_RULES:
        index = build_index(spark, pages, [r.asDict() for r in few], url)
        made = rows.withColumn("found", _judged(spark, index)("subject"))
        return made.withColumn("found", F.when(F.col("found.rule").isNotNull(), F.col("found")))
    return attach(rows, _joined(pages, rules, url), ["subject"], "pages").select("row", "subject", "found")


def url_verdicts(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """`(key, host, path, rule, pattern, tier, verdict)` per row; rule, pattern and tier are null where no rule matches."""
    made = with_verdicts(pages.select(key, url), rules, url, default)
    return made.select(
        F.col(f"row.{key}").alias(key), host_of(f"row.{url}").alias("host"), path_of(f"row.{url}").alias("path"),
        F.col("found.rule").alias("rule"), F.col("found.pattern").alias("pattern"), F.col("found.tier").alias("tier"),
        F.coalesce("found.verdict", F.lit(default)).alias("verdict"))


def keep_allowed(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """The rows whose verdict is `allow`, with all their columns."""
    made = with_verdicts(pages, rules, url, default)
    return made.where(F.coalesce("found.verdict", F.lit(default)) == "allow").select("row.*")
