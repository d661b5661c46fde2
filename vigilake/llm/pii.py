"""Personal data by weak supervision.

Candidates come from the base patterns and from looser ones (spelled-out mail
addresses, phone numbers without a country code, other separators). Five
labelers vote on each: the base pattern, the shape (checksum, ranges, digits), a
gazetteer (domains, issuers, networks, codes), words before it, and what it is
embedded in. Expectation-maximisation over the counted vote patterns estimates
how reliable each labeler is; its posteriors train a logistic classifier on the
votes and the length. Base spans stay; other candidates are added when the
classifier is sure and the shape holds.

The vote patterns of a kind are at most 3^6 however large the corpus is, so
both trainings are one expression over one short array, inside Spark.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from vigilake.llm.common import count_of, hits, joined, staged

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "shape", "gazetteer", "context", "embedded")
EM_STEPS, LOGISTIC_STEPS, SURE = 25, 150, 0.95
ABSTAIN, YES, NO = "0", "1", "2"

# The base expressions, written so that no start is tried twice: a match begins
# where its run of characters begins or where the match before it ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++\x20?[\[(]\x20?at\x20?[\])]\x20?[a-z0-9-]++(?:\x20?(?:\.|[\[(]\x20?dot\x20?[\])])\x20?[a-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:.])",
    "card": r"(?<![0-9])[0-9]{4}(?<sep>[./_]|\x20{2})[0-9]{4}\k<sep>[0-9]{4}\k<sep>[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z.+-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z-])",
}
# What a text must hold for a pattern to be worth a pass.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": "+"}
LOOSE_NEEDS = {"email": r"(?i)[\[(]\x20?at\x20?[\])]", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", "card": r"[0-9]{4}(?:[./_]|\x20{2})[0-9]{4}", "phone": r"[0-9]{3}[.-][0-9]{4}"}
GAZETTEER = {
    "email": r"(?i)\b(?:com|org|net|edu|gov|int|info|biz|io|eu|uk|us|de|fr|es|it|nl|ch|at|be|pt|pl|se|no|dk|fi|ie|ca|au|nz|jp|cn|in|br|mx|ar)$",
    "ip": r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.|:",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5)|35)",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|^\(?[2-9][0-9]{2}",
}
CUES = {
    "email": r"e-?mail|mail|contact|correo|courriel|kontakt|write to|schreib",
    "ip": r"\bip\b|address|adresse|host|server|direcci|serveur|login|logged",
    "card": r"card|karte|carte|tarjeta|visa|master|credit|kredit|payment|paid",
    "phone": r"phone|\btel|call|fax|mobil|cell|handy|anruf|appel|llam|whatsapp",
}
AGAINST = r"version|isbn|invoice|order|rechnung|factur|page|chapter|figure|serial|article|patent"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(hit: Column) -> Column:
    parts = F.transform(F.regexp_extract_all(F.reverse(_digits(hit)), F.lit("[0-9]"), F.lit(0)), _luhn_digit)
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0


def _luhn_digit(c: Column, i: Column) -> Column:
    d = c.cast("int")
    return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))


def _shape(kind: str, hit: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = r"0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return hit.rlike(rf"^{part}(?:\.{part}){{3}}$|:")
    n = F.length(_digits(hit))
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(hit)).otherwise(False)
    return n.between(8, 15)


def _voted(kind: str, text: Column, pattern: str, base: bool) -> Column:
    def vote(h: Column) -> Column:
        hit, start, end = h["hit"], h["start"], h["end"]
        before = F.lower(F.substr(text, F.greatest(start - 39, F.lit(1)), F.least(start, F.lit(40))))
        around = F.concat(F.substr(text, start, F.least(start, F.lit(1))), F.lit(" "), F.substr(text, end + 1, F.lit(1)))
        good = _shape(kind, hit)
        ballot = F.concat(
            F.lit(YES if base else ABSTAIN),
            F.when(good, F.lit(YES)).otherwise(F.lit(NO)),
            F.when(hit.rlike(GAZETTEER[kind]), F.lit(YES)).otherwise(F.lit(NO)),
            F.when(before.rlike(CUES[kind]), F.lit(YES)).when(before.rlike(AGAINST), F.lit(NO)).otherwise(F.lit(ABSTAIN)),
            F.when(around.rlike(r"[\p{L}\p{N}_]"), F.lit(NO)).otherwise(F.lit(ABSTAIN)),
            F.when(end - start < 13, F.lit("0")).when(end - start < 20, F.lit("1")).otherwise(F.lit("2")),
        )
        return F.struct(
            F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"),
            (good if base else F.lit(False)).alias("base"), ballot.alias("ballot"), good.alias("good"),
        )

    return F.transform(hits(text, pattern), vote)


def candidates(texts: DataFrame) -> DataFrame:
    """Rows with ``spans``: all candidates of the text with their ballots."""
    text, none = F.col("text"), F.array().cast("array<struct<kind:string,start:int,end:int,base:boolean,ballot:string,good:boolean>>")
    parts = []
    for kind in KINDS:
        need = NEEDS[kind]
        has = F.contains(text, F.lit(need)) if len(need) == 1 else text.rlike(need)
        parts.append(F.when(has, _voted(kind, text, BASE[kind], True)).otherwise(none))
        parts.append(F.when(text.rlike(LOOSE_NEEDS[kind]), _voted(kind, text, LOOSE[kind], False)).otherwise(none))
    return texts.withColumn("spans", reduce(F.concat, parts)).drop("text")


def _score(theta: str, row: str, at: int) -> str:
    return " + ".join(f"ln({theta}[{at} + {3 * k} + {row}.v[{k}]])" for k in range(len(LABELERS)))


def _em(rows: str) -> str:
    """Posterior of every vote pattern: ``rows`` with ``q``. The parameters are
    the prior and, for no and yes, each labeler's three votes; 20 imagined
    candidates of the start values keep small corpora steady."""
    size = 3 * len(LABELERS)
    start = "array(0.5D, " + ", ".join(["0.5D, 0.1D, 0.4D"] * len(LABELERS) + ["0.3D, 0.6D, 0.1D"] * len(LABELERS)) + ")"
    post = (
        f"transform({rows}, r -> named_struct('v', r.v, 'n', r.n, 'q', 1D / (1D + exp("
        f"(ln(1D - t[0]) + {_score('t', 'r', 1)}) - (ln(t[0]) + {_score('t', 'r', 1 + size)})))))"
    )
    weight = f"x.n * if(k < {size}, 1D - x.q, x.q)"
    maximised = (
        "concat(array((aggregate(qs, 0D, (s, x) -> s + x.n * x.q) + 10D) / (aggregate(qs, 0D, (s, x) -> s + x.n) + 20D)), "
        f"transform(sequence(0, {2 * size - 1}), k -> "
        f"(aggregate(qs, 0D, (s, x) -> s + if(x.v[(k % {size}) div 3] = k % 3, {weight}, 0D)) + 20D * {start}[k + 1]) / "
        f"(aggregate(qs, 0D, (s, x) -> s + {weight}) + 20D)))"
    )
    fitted = f"aggregate(sequence(1, {EM_STEPS}), {start}, (t, i) -> transform(array({post}), qs -> {maximised})[0])"
    return f"transform(array({fitted}), t -> {post})[0]"


def _logistic(rows: str) -> str:
    """Weights of the votes and the length, by gradient steps on posteriors."""
    fields = len(LABELERS) + 1
    z = " + ".join(f"w[{3 * k} + x.v[{k}]]" for k in range(fields))
    errors = f"transform({rows}, x -> named_struct('v', x.v, 'e', x.n * (x.q - 1D / (1D + exp(-({z}))))))"
    total = f"aggregate({rows}, 0D, (s, x) -> s + x.n)"
    step = (
        f"transform(array({errors}), es -> transform(w, (c, k) -> c * 0.999D + 2D / ({total}) * "
        "aggregate(es, 0D, (s, x) -> s + if(x.v[k div 3] = k % 3, x.e, 0D))))[0]"
    )
    return f"aggregate(sequence(1, {LOGISTIC_STEPS}), array_repeat(0D, {3 * fields}), (w, i) -> {step})"


def train(found: DataFrame) -> DataFrame:
    """One row: ``model``, from kind and ballot to the classifier's probability."""
    fields = len(LABELERS) + 1
    ballots = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.ballot").agg(F.count(F.lit(1)).alias("n"))
    votes = F.array(*[F.substr("ballot", F.lit(k + 1), F.lit(1)).cast("int") for k in range(fields)])
    by_kind = ballots.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("ballot", votes.alias("v"), F.col("n").cast("double").alias("n")))).alias("rows"))
    z = " + ".join(f"w[{3 * k} + x.v[{k}]]" for k in range(fields))
    return (
        by_kind.withColumn("qs", F.expr(_em("rows"))).withColumn("w", F.expr(_logistic("qs")))
        .select(F.explode(F.expr(f"transform(rows, x -> named_struct('key', concat(kind, x.ballot), 'p', 1D / (1D + exp(-({z})))))")).alias("m"))
        .agg(F.map_from_entries(F.array_sort(F.collect_list("m"))).alias("model"))
    )


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and ``found``, the array of (kind, start,
    end, base, probability) of all spans by kind, then start.

    NULL and empty texts hold nothing; NULL ids and repeated rows are rows like
    others; an empty table gives no rows. Only the two named columns are read,
    so others may have any name.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = staged(candidates(texts), "candidates")
    model = train(rows).scalar()
    known = rows.withColumn("model", model)
    scored = F.transform("spans", lambda s: F.struct(
        F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).alias("place"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"),
        s["base"].alias("base"), s["good"].alias("good"), F.coalesce(F.element_at("model", F.concat(s["kind"], s["ballot"])), F.lit(0.0)).alias("probability"),
    ))
    base = F.filter("spans", lambda s: s["base"])
    kept = F.filter(scored, lambda s: s["base"] | (s["good"] & (s["probability"] >= SURE) & ~F.exists(
        base, lambda b: (b["kind"] == s["kind"]) & (b["start"] < s["end"]) & (s["start"] < b["end"]))))
    return known.select(F.col("id").alias(id_col), F.transform(F.array_sort(kept), lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), s["probability"].alias("probability"))).alias("found"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and the hash of the base spans, and all spans."""
    base = F.filter("found", lambda s: s["base"])
    return found.withColumn("_base", base).select(
        id_col, *[count_of("_base", k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.col("_base")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"),
        (F.size("found") - F.size("_base")).cast("long").alias("n_added"),
    )
