"""Secret scans over a trigram inverted index.

Each rule's pattern is turned into a Boolean query over trigrams: a set of
alternatives, each a set of trigrams that a match must hold. The index posts the
trigrams of the rules' vocabulary (case folded); a document is a candidate of a
rule when the postings of all trigrams of one alternative meet in it. Candidates
are verified with the pattern. Rules without mandatory trigrams scan all texts.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vigilake.llm.common import count_of, hits, joined, staged


@dataclass(frozen=True)
class Rule:
    """``parts`` say what a match is made of, in order: a literal, a tuple of
    literals of which one is there ("" for none), or None for anything.
    ``pattern`` is the expression; ``group`` is what ``least`` characters are
    asked of (0: the whole match). Base rules count in the digest. ``block``,
    where given, is what ``redacted`` cuts out in place of ``pattern``: the same
    match and all of the secret that follows it."""

    kind: str
    pattern: str
    parts: tuple[str | tuple[str, ...] | None, ...] = (None,)
    group: int = 0
    least: int = 1
    base: bool = False
    block: str = ""


KEY_LINE = r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"
# Up to the END line where it is the next line of dashes; else the header lines
# and base64 that follow: long runs after any gap, and shorter ones that are a
# line of their own or, on the same line, no plain word. Line ends may be escaped.
_GAP, _END_OF_LINE = r"(?:[\s>]|\\[nr])", r"(?:\r?\n|\\r\\n|\\n)"
KEY_BLOCK = KEY_LINE + (
    r"(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----"
    rf"|(?:{_GAP}*+(?:Proc-Type|DEK-Info|Key-Info|MIC-Info|Content-Domain|Originator-[A-Za-z-]+|Comment|Version):[^\n\\]*+)*+"
    rf"(?:{_GAP}++[A-Za-z0-9+/]{{16,}}+={{0,2}}+"
    rf"|{_END_OF_LINE}[\x20\t>]*+[A-Za-z0-9+/]++={{0,2}}+(?=[\x20\t]*(?:{_END_OF_LINE}|\\?[\"']|\z))"
    r"|[\x20\t]++(?=[A-Za-z+/]*[0-9+/=])[A-Za-z0-9+/]++={0,2}+(?![^\s\\\"'])"
    r")*+)"
)

RULES = (
    Rule(
        "assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        (("password", "passwd", "secret", "token", "apikey", "api_key"), None), 1, 8, True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", ("AKIA", None), 0, 16, True),
    # A run is taken whole, so only runs of 32 and more need to match.
    Rule("hex", r"[0-9a-f]{32,}+", (None,), 0, 32, True),
    Rule("private_key", KEY_LINE, ("-----BEGIN ", None, "PRIVATE KEY-----"), block=KEY_BLOCK),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ("eyJ", None, ".eyJ", None, ".", None)),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}", ("gh", ("p", "o", "u", "s", "r"), "_", None)),
)


def trigram_query(rule: Rule) -> list[frozenset[str]]:
    """Alternatives of case-folded trigrams; an empty one makes no demand, and
    so the whole query none. Literal neighbours are joined before cutting."""
    runs: list[list[str]] = [[""]]
    for part in rule.parts:
        if part is None:
            runs.append([""])
        else:
            runs[-1] = [a + b for a, b in product(runs[-1], (part,) if isinstance(part, str) else part)]
    choices = [[frozenset(s.lower()[i:i + 3] for i in range(len(s) - 2)) for s in run] for run in runs]
    # A run with a choice too short for a trigram demands nothing.
    choices = [c for c in choices if all(c)]
    whole = {frozenset().union(*pick) for pick in product(*choices)} if choices else {frozenset()}
    return sorted(whole, key=sorted)


def postings(texts: DataFrame, grams: list[str]) -> DataFrame:
    """The index: one row (gram, id) for every trigram of the vocabulary that
    the case-folded text of a row holds."""
    folded = texts.where("text <> ''").select("id", F.lower("text").alias("low"))
    found = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams])) if grams else F.array().cast("array<string>")
    return folded.select("id", F.explode(found).alias("gram")).distinct()


def candidates(posted: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(id, kinds): the rules whose query the postings answer for a document."""
    spark = posted.sparkSession
    asked = [
        (rule.kind, f"{rule.kind}:{i}", gram, len(grams))
        for rule in rules for i, grams in enumerate(trigram_query(rule)) for gram in sorted(grams)
    ]
    # From Arrow, as a list of tuples would be read by Python workers.
    names = ["kind", "choice", "gram", "wanted"]
    columns = list(zip(*asked, strict=True)) or [()] * 4
    kinds = [pa.string()] * 3 + [pa.int32()]
    plan = spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names))
    return (
        posted.join(plan, "gram").groupBy("id", "kind", "choice").agg(F.count(F.lit(1)).alias("met"), F.first("wanted").alias("wanted"))
        .where("met = wanted").groupBy("id").agg(F.collect_set("kind").alias("kinds"))
    )


def _found(rule: Rule, text: Column) -> Column:
    """Verified spans of one rule: (kind, start, end)."""
    good = F.filter(hits(text, rule.pattern, rule.group), lambda h: F.length(h["hit"]) >= rule.least)
    return F.transform(good, lambda h: F.struct(F.lit(rule.kind).alias("kind"), h["start"].alias("start"), h["end"].alias("end")))


def _in_order(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """By start, then by the order of the rules."""
    place = lambda s: F.array_position(F.array(*[F.lit(r.kind) for r in rules]), s["kind"])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), place(s).alias("place"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """One row per row of ``docs``: id (with ``whole``, the whole row) and ``found``, the array of (kind, start,
    end) of all secrets by start, then by the order of the rules.

    NULL and empty texts hold nothing. Rows without an id are scanned with every
    rule, since no posting can name them; repeated rows get equal results. Other
    columns are not read, whatever their names.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *([F.struct("*").alias("row")] if whole else []))
    asked = [r for r in rules if all(trigram_query(r))]
    grams = sorted({g for r in asked for q in trigram_query(r) for g in q})
    marked = staged(candidates(postings(texts, grams), tuple(asked)), "candidates")
    rows = texts.join(marked, "id", "left").withColumn("kinds", F.when(F.col("id").isNull(), F.array(*[F.lit(r.kind) for r in rules])).otherwise(F.col("kinds")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    parts = []
    for rule in rules:
        # A cheap test first: most texts that are scanned in full hold nothing.
        check = F.array_contains("kinds", rule.kind) if rule in asked else F.col("text").rlike(rule.pattern)
        parts.append(F.when(check, _found(rule, F.col("text"))).otherwise(none))
    return rows.select(F.col("row") if whole else F.col("id").alias(id_col), _in_order(reduce(F.concat, parts), rules).alias("found"))


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base rules, the hash of their spans, and all spans."""
    base = [r.kind for r in rules if r.base]
    of_base = F.filter("found", lambda s: s["kind"].isin(base))
    return found.select(
        id_col,
        *[count_of("found", k).alias(f"n_{k}") for k in base],
        F.sha2(joined(of_base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"),
    )


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``[kind]`` in place of each secret, all columns kept;
    overlapping secrets are cut out together under the kind of the first. Of a
    rule with a ``block`` all of the block goes, a private key with its body."""
    rules = tuple(replace(r, pattern=r.block or r.pattern) for r in rules)
    rows = scan(docs, rules, id_col, text_col, whole=True)
    text = F.col(f"row.{text_col}")

    def step(state: Column, s: Column) -> Column:
        gap = F.substr(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(s["start"] < state["at"], state["out"]).otherwise(F.concat(state["out"], gap, F.lit("["), s["kind"], F.lit("]"))).alias("out"),
        )

    cut = F.aggregate("found", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1)))
    return rows.select(*[F.when(F.size("found") > 0, cut).otherwise(text).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
