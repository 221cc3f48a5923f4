"""Secret scanning through a trigram inverted index.

Every rule is a regular expression. A Boolean query over trigrams is derived from it (regex_query): the text of every
match satisfies that query. Postings (trigram, text) are built for the trigrams that some query names, and intersected
by text; texts that satisfy a rule's query are candidates and are verified by the expression itself. A rule from whose
expression no mandatory trigram follows scans every text. All of it is DataFrame functions: no text leaves the JVM, and
Python only reads the expressions, on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import regex_query
from .scratch import Scratch


@dataclass(frozen=True)
class Rule:
    """group and least: characters that a group of a match must have; base: one of the kinds that are always asked for."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False

    def query(self) -> tuple[regex_query.Query, bool]:
        """The trigram query, and whether it is about the lower-cased text."""
        return regex_query.derive(self.pattern)


#: The three base kinds as specified.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]+", 0, 16, True),
)
#: Kinds that the index adds, by the public formats of their issuers.
ADDED = (
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)
RULES = BASE + ADDED
#: A run of 16 hex digits is found with the bound in the expression, which matches the same runs: a run is
#: maximal, so every shorter one fails and hides nothing.
SHORT_CUT = {"hex": r"[0-9a-f]{16,}", "access": r"AKIA[A-Z0-9]{14,}"}
#: Matches of a text whose places are summed up together.
BLOCK = 256


def _terms(rules: tuple[Rule, ...]) -> list[tuple[str, bool]]:
    return sorted({(t, fold) for query, fold in (r.query() for r in rules) for t in regex_query.trigrams(query)})


def postings(texts: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "key", text: str = "text") -> DataFrame:
    """The index: (key, term) for every text that holds the trigram of a term; terms are numbered by _terms."""
    both = texts.select(F.col(key).alias(key), F.col(text).alias("text"), F.lower(F.col(text)).alias("low"))
    has = (F.col("low" if fold else "text").contains(t) for t, fold in _terms(rules))
    held = F.array_compact(F.array(*(F.when(x, F.lit(i)) for i, x in enumerate(has))))
    return both.select(F.col(key), F.explode(held).alias("term"))


def _satisfied(query: regex_query.Query, number: dict[str, int]) -> Column:
    """Whether the terms of a text satisfy a query."""
    if isinstance(query, str):
        return F.array_contains("terms", number[query])
    if query[0] == "and":
        wanted = sorted(number[t] for t in query[1] if isinstance(t, str))
        parts = [F.size(F.array_except(F.array(*map(F.lit, wanted)), F.col("terms"))) == 0] if wanted else []
        parts += [_satisfied(q, number) for q in sorted(query[1], key=str) if not isinstance(q, str)]
        return reduce(Column.__and__, parts)
    return reduce(Column.__or__, [_satisfied(q, number) for q in sorted(query[1], key=str)])


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "key") -> DataFrame:
    """(key, rules): a bit for each rule whose Boolean trigram query the postings of a key satisfy."""
    terms = _terms(rules)
    got = index.groupBy(key).agg(F.collect_set("term").alias("terms"))  # no longer than the terms of all rules
    bits = F.lit(0)
    for r, rule in enumerate(rules):
        query, fold = rule.query()
        if query is not True:
            ok = _satisfied(query, {t: i for i, (t, f) in enumerate(terms) if f == fold})
            bits = bits + F.when(ok, 1 << r).otherwise(0)
    return got.select(key, bits.alias("rules")).where("rules > 0")


def _placed(runs: Column) -> Column:
    """Starts and ends of hits from the lengths of gaps and hits.

    Arrays that grow by one are copied at each step. Running sums are therefore taken in blocks and over blocks, so the
    time of a text follows its matches, however many they are.
    """
    none = F.array().cast("array<struct<start:int,end:int>>")

    def add(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        end = start + x["hit"]
        return F.struct(
            end.alias("at"), F.concat(s["out"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("out")
        )

    def block(b: Column) -> Column:
        return F.aggregate(F.slice(runs, b + 1, F.lit(BLOCK)), F.struct(F.lit(0).alias("at"), none.alias("out")), add)

    def next_block(s: Column, b: Column) -> Column:
        return F.struct((s["at"] + b["at"]).alias("at"), F.concat(s["before"], F.array(s["at"])).alias("before"))

    def moved(b: Column, before: Column) -> Column:
        return F.transform(
            b["out"], lambda s: F.struct((s["start"] + before).alias("start"), (s["end"] + before).alias("end"))
        )

    def joined(blocks: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("before"))
        return F.flatten(F.zip_with(blocks, F.aggregate(blocks, zero, next_block, lambda s: s["before"]), moved))

    blocks = F.transform(F.sequence(F.lit(0), F.size(runs) - 1, F.lit(BLOCK)), block)
    return F.when(F.size(runs) == 0, none).otherwise(F.get(F.transform(F.array(blocks), joined), F.lit(0)))


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of the leftmost non-overlapping matches that pass, in code points, end exclusive."""
    pattern = F.lit(SHORT_CUT.get(rule.kind, rule.pattern))
    gaps = F.split(text, SHORT_CUT.get(rule.kind, rule.pattern), -1)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    runs = F.transform(
        F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("hit")),
        lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit")),
    )
    # bound to a name by an array of one, so that the text is matched once and not once a block
    out = F.get(F.transform(F.array(runs), _placed), F.lit(0))
    if rule.kind in SHORT_CUT or not rule.least:
        return out
    groups = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    long_enough = F.transform(
        F.arrays_zip(out.alias("s"), groups.alias("g")), lambda z: F.when(F.length(z["g"]) >= rule.least, z["s"])
    )
    return F.array_compact(long_enough)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and one column of spans for each rule, for every row; null text is empty.

    Texts are keyed by hash in the index: equal texts share their postings, and two texts that share a hash only
    verify each other's candidates. Rows that repeat are scanned and returned each; null ids stay null.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).withColumn("key", F.xxhash64("text"))
    # written, so that its size is known: small hits are broadcast, others joined with hot keys split
    hits = Scratch(docs.sparkSession, "secrets").written(candidates(postings(rows, rules), rules), "hits")
    joined = rows.join(hits, "key", "left").withColumn("rules", F.coalesce("rules", F.lit(0)))
    none = F.array().cast("array<struct<start:int,end:int>>")
    out = []
    for r, rule in enumerate(rules):
        found = spans(F.col("text"), rule)
        if rule.query()[0] is not True:
            found = F.when(F.col("rules").bitwiseAND(F.lit(1 << r)) != 0, found).otherwise(none)
        else:
            found = F.when(F.col("text").rlike(SHORT_CUT.get(rule.kind, rule.pattern)), found).otherwise(none)
        out.append(found.alias(rule.kind))
    return joined.select("doc_id", *out)


def _written_out(rules: tuple[Rule, ...]) -> Column:
    def tagged(place: int, kind: str) -> Column:
        return F.transform(
            F.col(kind),
            lambda s: F.struct(
                s["start"].alias("start"),
                F.lit(place).alias("kind"),
                F.concat_ws(":", F.lit(kind), s["start"], s["end"]).alias("said"),
            ),
        )

    return F.array_join(
        F.transform(F.array_sort(F.concat(*(tagged(i, r.kind) for i, r in enumerate(rules)))), lambda x: x["said"]), ","
    )


def digest(scanned: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of scan()'s rows."""
    base = tuple(r for r in rules if r.base)
    counts = [F.size(r.kind).cast("long").alias(f"n_{r.kind}") for r in base]
    return scanned.select(
        "doc_id", *counts, F.sha2(_written_out(base).cast("binary"), 256).alias("base_sha256"), _written_out(rules).alias("spans")
    )
