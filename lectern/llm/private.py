"""Personal data by weak supervision, in DataFrame functions only.

Regular expressions propose spans. Labelers vote on each: the strict form of its kind,
a gazetteer, words before it that speak for or against personal data, and how it is set
in the text; each may abstain. Expectation-maximisation over the patterns of votes
estimates how reliable each labeler is and how likely each pattern is personal data;
these soft labels train the final classifier, naive Bayes over features of the span.
Spans of the strict form are always kept; others are added where the classifier says so.

The patterns of votes and the features have fixed, small domains, so the two fits
read aggregates whose size does not depend on the data.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import materialise

#: In the order of reports; the first four have a strict form.
KINDS = ("email", "ip", "card", "phone", "ssn", "name")
#: The strict form of each kind. Possessive and anchored so that they are
#: linear in the text; they match what the plain forms match.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Other forms that the votes decide on.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]{1,63}+){1,4}+",
    "phone": r"(?<!\+[0-9]{1,3}[ .-]{0,2})(?<![0-9.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-]?[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]{1,20}+(?: [A-Z][a-z]{1,20}+)?+",
}
#: Gazetteers and cue words, in lower case.
MAIL_WORDS = ("mail", "gmail", "outlook", "hotmail", "yahoo", "proton", "icloud", "aol", "gmx", "web")
FIRST_NAMES = ("alice", "anna", "carlos", "david", "elena", "emma", "hans", "james", "john", "jose", "juan", "laura", "lena", "linda", "lucas", "maria", "marie", "mary", "michael", "paul", "peter", "pierre", "robert", "sarah", "sofia", "thomas")
CARD_STARTS = "^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"
CUES = ("email", "e-mail", "mail", "contact", "write to", "phone", "tel", "call", "mobile", "fax", "whatsapp", "ip", "host", "server", "from address", "card", "visa", "mastercard", "credit", "debit", "account", "ssn", "social security", "patient", "name is", "dear", "signed")
AGAINST = ("version", "ver.", "v.", "isbn", "issn", "doi", "order no", "invoice", "serial", "chapter", "section", "figure", "fig.", "page", "release", "build", "token", "hash", "example")
CONTEXT = 40
LABELERS = 5
ABSTAIN, FOR, AGAINST_IT = 0, 1, 2
ROUNDS = 25


def _found(text: Column, pattern: str, likely: Column) -> Column:
    """Array of (gap before, match, text before, text after) of a pattern's matches, none unless ``likely``.

    What split() leaves between the matches gives their places without counting.
    """
    parts = F.split(text, pattern, -1)
    # zipped first: an expression inside the function would be worked out anew for each match
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), parts.alias("p"), F.slice(parts, F.lit(2), F.size(parts)).alias("q"))
    rows = F.transform(
        F.filter(zipped, lambda z: z["m"].isNotNull()),
        lambda z: F.struct(
            F.length(z["p"]).cast("long").alias("gap"),
            z["m"].alias("match"),
            F.substring(z["p"], -CONTEXT, CONTEXT).alias("before"),
            F.substring(z["q"], 1, 2).alias("after"),
        ),
    )
    return F.when(likely & F.regexp_like(text, F.lit(pattern)), rows)


def _named(kind: str, strict: bool, rows: Column) -> Column:
    return F.transform(rows, lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(strict).alias("strict"), *[x[c].alias(c) for c in ("gap", "match", "before", "after")]))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.split(F.reverse(digits), "")
    double = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, double(F.get(back, i - 1).cast("int"))).otherwise(F.get(back, i - 1).cast("int")))
    return total % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    """Whether a match of a strict form passes the check of its kind."""
    n = F.length(_digits(match))
    small = F.forall(F.split(match, "\\."), lambda x: F.length(F.regexp_replace(x, "^0+", "")) < 4) & F.forall(F.split(match, "\\."), lambda x: F.substring(F.regexp_replace(x, "^0+(?=.)", ""), 1, 4).cast("int") <= 255)
    return F.when(kind == "email", True).when(kind == "ip", small).when(kind == "card", F.when(n.between(12, 19), _luhn(_digits(match))).otherwise(False)).otherwise(n.between(9, 15))


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs``' ``row`` with (kind, strict, start, end, match, before, after) of every proposed span."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digit, at, any_ = F.regexp_like(text, F.lit("[0-9]")), text.contains("@"), F.lit(True)
    likely = {"email": at, "ip": digit, "card": digit, "phone": text.contains("+")}
    lists = [_named(k, True, _found(text, STRICT[k], likely[k])) for k in STRICT]
    likely = {"email": text.contains("at") | text.contains("AT"), "phone": digit, "ssn": digit, "name": any_}
    lists += [_named(k, False, _found(text, LOOSE[k], likely[k])) for k in LOOSE]
    empty = F.array().cast("array<struct<kind:string,strict:boolean,gap:bigint,match:string,before:string,after:string>>")
    return docs.select("row", F.concat(*[F.coalesce(x, empty) for x in lists]).alias("found"))


def _placed(found: DataFrame) -> DataFrame:
    rows = found.select("row", F.posexplode("found").alias("nth", "f")).select("row", "nth", "f.*")
    before = Window.partitionBy("row", "kind", "strict").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("match").cast("long")
    return rows.withColumn("end", F.sum(F.col("gap") + size).over(before)).withColumn("start", F.col("end") - size)


def _any_word(text: Column, words: tuple[str, ...]) -> Column:
    return F.regexp_like(F.lower(text), F.lit("(?<![a-z])(?:" + "|".join(w.replace(".", "\\.") for w in words) + ")(?![a-z])"))


def votes(spans: DataFrame) -> DataFrame:
    """``spans`` with ``v``, the labelers' votes."""
    kind, match = F.col("kind"), F.col("match")
    low = F.lower(match)
    strict = F.when(F.col("strict"), F.when(F.col("valid"), FOR).otherwise(AGAINST_IT)).otherwise(ABSTAIN)
    gazetteer = (
        F.when(kind == "email", F.when(F.regexp_like(low, F.lit("(?:" + "|".join(MAIL_WORDS) + ")")), FOR).otherwise(ABSTAIN))
        .when(kind == "card", F.when(F.regexp_like(_digits(match), F.lit(CARD_STARTS)), FOR).otherwise(AGAINST_IT))
        .when(kind == "name", F.when(_any_word(match, FIRST_NAMES), FOR).otherwise(ABSTAIN))
        .when(kind == "ip", F.when(F.regexp_like(match, F.lit("^(?:0|127|255)\\.")), AGAINST_IT).otherwise(ABSTAIN))
        .when(kind == "ssn", F.when(F.regexp_like(match, F.lit("^(?:000|666|9)|-00-|-0000$")), AGAINST_IT).otherwise(ABSTAIN))
        .otherwise(ABSTAIN)
    )
    cue = F.when(_any_word("before", CUES), FOR).otherwise(ABSTAIN)
    against = F.when(_any_word("before", AGAINST), AGAINST_IT).otherwise(ABSTAIN)
    glued = F.regexp_like("before", F.lit("[\\w#$%&*=/\"-]$")) | F.regexp_like("after", F.lit("^[\\w#$%&*=/\"-]"))
    return spans.withColumn("v", F.array(*[x.cast("int") for x in (strict, gazetteer, cue, against, F.when(glued, AGAINST_IT).otherwise(FOR))]))


def _total(rows: Column, value: Callable[[Column], Column]) -> Column:
    return F.aggregate(rows, F.lit(0.0), lambda s, p: s + value(p))


def reliabilities(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, v, posterior) for each pattern (kind, v, n), by expectation-maximisation.

    The state holds a prior for each kind and, for each labeler, vote and class, the
    probability of the vote; all rounds run as one expression over the array of patterns.
    """
    start = [(0.55, 0.1, 0.35)[v] if y == 0 else (0.35, 0.6, 0.05)[v] for _ in range(LABELERS) for v in range(3) for y in (0, 1)]
    state = F.struct(F.array(*[F.lit(0.5)] * len(KINDS)).alias("prior"), F.array(*[F.lit(x) for x in start]).alias("vote"))
    at = lambda a, i: F.element_at(a, i + 1)

    def weighed(s: Column, p: Column) -> Column:
        both = [
            reduce(lambda a, b: a * b, [at(s["vote"], 6 * k + 2 * F.element_at(p["v"], k + 1) + y) for k in range(LABELERS)]) * (at(s["prior"], p["k"]) if y else 1 - at(s["prior"], p["k"]))
            for y in (0, 1)
        ]
        return both[1] / (both[0] + both[1])

    def step(s: Column) -> Column:
        # two levels of transform, so that each posterior is computed once a round
        once = F.transform(F.array(F.transform(F.col("p"), lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v"), p["n"].alias("n"), weighed(s, p).alias("q")))), lambda soft: _maximised(soft))
        return F.element_at(once, 1)

    def _maximised(soft: Column) -> Column:
        prior = [(1 + _total(soft, lambda p, k=k: F.when(p["k"] == k, p["n"] * p["q"]).otherwise(0.0))) / (2 + _total(soft, lambda p, k=k: F.when(p["k"] == k, p["n"]).otherwise(0.0))) for k in range(len(KINDS))]
        vote = []
        for k in range(LABELERS):
            for v in range(3):
                for y in (0, 1):
                    share = lambda p, y=y: p["n"] * (p["q"] if y else 1 - p["q"])
                    here = _total(soft, lambda p, k=k, v=v, share=share: F.when(F.element_at(p["v"], k + 1) == v, share(p)).otherwise(0.0))
                    vote.append((start[6 * k + 2 * v + y] * 10 + here) / (10 + _total(soft, share)))
        return F.struct(F.array(*prior).alias("prior"), F.array(*vote).alias("vote"))

    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    whole = patterns.groupBy().agg(F.sort_array(F.collect_list(F.struct(number.alias("k"), F.col("v"), F.col("n").cast("double").alias("n")))).alias("p"))
    fitted = whole.withColumn("s", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), state, lambda s, _: step(s)))
    out = fitted.select(F.explode(F.transform("p", lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v"), weighed(F.col("s"), p).alias("posterior")))).alias("x"))
    return out.select(F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("x.k") + 1).alias("kind"), "x.v", "x.posterior")


def features(spans: DataFrame) -> Column:
    """Names of the features of a span, from a fixed domain of a few hundred."""
    kind, match = F.col("kind"), F.col("match")
    digits = F.length(_digits(match))
    own = [
        F.concat(F.lit("kind="), kind),
        F.concat_ws("=", kind, F.lit("form"), F.when(F.col("strict"), "strict").otherwise("loose")),
        F.concat_ws("=", kind, F.lit("valid"), F.col("valid").cast("string")),
        F.concat_ws("=", kind, F.lit("length"), F.least(F.floor(F.length(match) / 4), F.lit(10)).cast("string")),
        F.concat_ws("=", kind, F.lit("digits"), F.least(digits, F.lit(20)).cast("string")),
        F.concat_ws("=", F.lit("cue"), F.get("v", F.lit(2)).cast("string")),
        F.concat_ws("=", F.lit("against"), F.get("v", F.lit(3)).cast("string")),
        F.concat_ws("=", F.lit("set"), F.get("v", F.lit(4)).cast("string")),
        F.concat_ws("=", kind, F.lit("gazetteer"), F.get("v", F.lit(1)).cast("string")),
    ]
    return F.array(*own)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans), one row per input row: the spans as (kind, start, end, strict), by place.

    Places are in code points, the end exclusive. A null text counts as empty. Rows are
    told apart by themselves, so repeated or null ids do no harm. Other columns are
    ignored. Spans of the strict forms are kept; a span the classifier adds never
    overlaps one of them.
    """
    rows = materialise(candidates(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("row", F.struct(F.monotonically_increasing_id().alias("n"), "id"))).select("row.n", "row.id", "found"), "pii-found")
    some = rows.where(F.size("found") > 0).select(F.col("n").alias("row"), "found")
    placed = _placed(some).withColumn("valid", F.when(F.col("strict"), _valid(F.col("kind"), F.col("match"))).otherwise(True))
    # a run of digits that cannot be a card is no candidate for one
    placed = placed.where((F.col("kind") != "card") | F.length(_digits(F.col("match"))).between(12, 19))
    voted = votes(placed)
    voted = materialise(voted.withColumn("x", features(voted)).select("row", "kind", "strict", "valid", "start", "end", "v", "x"), "pii-votes")
    soft = reliabilities(voted.groupBy("kind", "v").agg(F.count("*").alias("n")))
    labelled = voted.join(soft, ["kind", "v"]).select("x", "posterior")
    # naive Bayes: log-odds of each feature and of the whole, from soft counts
    sums = labelled.select(F.explode(F.concat(F.array(F.lit("")), F.col("x"))).alias("x"), "posterior").groupBy("x").agg(F.sum("posterior").alias("yes"), F.count("*").alias("n")).collect()
    whole = next(((r.yes, r.n) for r in sums if r.x == ""), (0.0, 0))
    odds = lambda yes, n: F.log(F.lit((yes + 1.0) / (n - yes + 1.0)))
    base = odds(*whole)
    weight = F.create_map(*[c for r in sums if r.x for c in (F.lit(r.x), odds(r.yes, r.n) - base)]) if len(sums) > 1 else F.create_map(F.lit(""), F.lit(0.0))
    score = base + F.aggregate(F.col("x"), F.lit(0.0), lambda s, f: s + F.coalesce(F.try_element_at(weight, f), F.lit(0.0)))
    kept = F.col("strict") & F.col("valid")
    judged = voted.withColumn("kept", kept).withColumn("likely", score > 0)
    # both frames run from the first row, as one that runs to the last is worked out anew for each row
    before = Window.partitionBy("row").orderBy("start", "end", F.desc("kept")).rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("end"), F.desc("kept")).rowsBetween(Window.unboundedPreceding, 0)
    ends = F.max(F.when(F.col("kept"), F.col("end"))).over(before)
    begins = F.min(F.when(F.col("kept"), F.col("start"))).over(behind)
    judged = judged.withColumn("ends", ends).withColumn("begins", begins)
    clear = (F.coalesce("ends", F.lit(0)) <= F.col("start")) & (F.coalesce("begins", F.col("end")) >= F.col("end"))
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    final = judged.where(F.col("kept") | (F.col("likely") & clear)).groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", order.alias("order"), "end", "kind", F.col("kept").alias("strict")))).alias("spans"))
    out = rows.select("n", "id").join(final, rows["n"] == final["row"], "left")
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,strict:boolean>>")
    return out.select(F.col("id").alias(id_col), F.coalesce(F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["strict"].alias("strict"))), none).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of strict spans by kind, base_sha256 and all spans as text."""
    base = F.filter("spans", lambda s: s["strict"])
    found = personal_data(docs)
    of = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of(k) for k in STRICT]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text) with each span replaced by its kind in angle brackets; ids must be unique and not null."""
    d = docs.select(id_col, text_col).join(personal_data(docs, id_col, text_col), id_col)
    one = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(F.concat(a["out"], F.substring(F.col(text_col), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("<"), s["kind"], F.lit(">")).alias("out"), s["end"].alias("at"))),
        lambda a: F.concat(a["out"], F.substring(F.col(text_col), (a["at"] + 1).cast("int"), F.length(text_col))),
    )
    return d.select(id_col, one.alias(text_col))
