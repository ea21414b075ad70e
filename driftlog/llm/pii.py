"""Personal data by weak supervision, in native columns.

Candidates are the spans of each kind's strict form and of some wider forms (obscured addresses,
numbers without country code, fifteen-digit cards, long ip forms). Five labelers vote yes, no or
nothing on each: its form, a gazetteer (top-level domains, issuers, country codes, reserved
blocks), words before it, its own checks, and its neighbours. How often each pattern of votes occurs
is counted over all candidates; expectation-maximisation on these counts (at most 3^5 for each kind
and length) finds each labeler's reliability and every pattern's probability, and a logistic span
classifier is trained on these. Strict spans that pass their checks always count; wider ones where
the classifier says so.

Strict forms are written so that Java's engine, too, finds them in linear time and without
recursion: runs are possessive, and a match may only begin where a run begins or the last match ended.

Defined cases: null and empty texts have no spans; spans of one kind do not overlap, of different
kinds they may; repeated rows are searched each; columns named like the new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlog.llm.common import materialise, table

KINDS = ("email", "ip", "card", "phone")
#: The strict form of each kind.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider forms, which need the other labelers' consent.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(](?:at|AT|arroba)[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}(?![0-9])",
    "phone": r"(?<![0-9+(.-])\(?[2-9][0-9]{2}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
}
#: What a text must hold for a form to be looked for at all.
GUARD = {
    ("email", True): "@", ("ip", True): r"[0-9]\.[0-9]++\.[0-9]", ("card", True): r"[0-9][\x20-]?[0-9]", ("phone", True): r"\+[0-9]",
    ("email", False): r"[\[(](?:at|AT|arroba)[\])]", ("ip", False): r"[0-9A-Fa-f]:[0-9A-Fa-f]", ("card", False): r"3[47][0-9]{2}", ("phone", False): r"[0-9][.-][0-9]{4}",
}
#: Words that speak for a kind when they stand shortly before a span, in the corpus's languages.
CUES = {
    "email": r"(?:e-?mail|mail|contact|write|adresse|correo|courriel|contacto|kontakt)\W*$",
    "ip": r"(?:\bip|address|host|server|serveur|servidor|adresse)\W*$",
    "card": r"(?:card|visa|mastercard|amex|karte|carte|tarjeta|payment|credit)\W*$",
    "phone": r"(?:phone|tel|call|mobile|fax|cell|telefon|telefono|anruf|appel|llame)\W*$",
}
AGAINST = r"(?:version|release|isbn|order|invoice|section|figure|serial|page|chapter)\W*$"
#: Common top-level domains.
DOMAINS = r"\.(?:com|org|net|edu|gov|mil|int|info|biz|io|co|de|fr|es|uk|us|eu|it|nl|ch|at|be|ca|au|mx|ar|cl|br|in|jp)$"
CONTEXT, VOTES, KEPT = 40, 5, 0.5
#: Items that are walked at a time, and code points in a block of text.
CHUNK, BLOCK = 256, 4096
REDUNDANT = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f mentions it."""
    return F.get(F.transform(F.array(value), f), 0)


def _walk(items: Column, none: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The rows that `step` gathers on its way over an array. It gets and returns struct(at, own): where it
    is, and what it has gathered. The array is walked in stretches of CHUNK, whose gatherings are put
    together once, so that the work does not grow with the array's square."""

    def over(acc: Column, chunk: Column) -> Column:
        start = F.struct(F.element_at(acc, -1)["at"].alias("at"), none.alias("own"))
        return F.concat(acc, F.array(F.aggregate(chunk, start, step)))

    def whole(x: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / CHUNK).cast("int")), lambda i: F.slice(x, i * CHUNK + 1, CHUNK))
        first = F.array(F.struct(F.lit(0).alias("at"), none.alias("own")))
        return F.aggregate(chunks, first, over, lambda acc: F.flatten(F.transform(acc, lambda y: y["own"])))

    return _let(items, whole)


def _found(text: Column, kind: str, strict: bool) -> Column:
    """array<struct<s, e, m, b, a>>: the matches with their places in code points, what stands before
    (CONTEXT characters, the match before them at most) and the character after."""
    form = (STRICT if strict else WIDE)[kind]
    none = F.array().cast("array<struct<s:int,e:int,m:string,b:string,a:string>>")
    empty = F.lit("")

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(acc["own"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"), x["b"].alias("b"), x["a"].alias("a")))).alias("own"))

    def placed(x: Column) -> Column:
        between, match = x["between"], x["match"]
        return F.transform(
            match,
            lambda m, i: F.struct(
                F.length(F.get(between, i)).alias("gap"), m.alias("m"),
                F.right(F.concat(F.coalesce(F.get(match, i - 1), empty), F.get(between, i)), F.lit(CONTEXT)).alias("b"),
                F.left(F.concat(F.coalesce(F.get(between, i + 1), empty), F.coalesce(F.get(match, i + 1), empty)), F.lit(1)).alias("a"),
            ),
        )

    split = F.struct(F.split(text, form, -1).alias("between"), F.regexp_extract_all(text, F.lit(form), F.lit(0)).alias("match"))
    walked = _let(split, lambda x: _let(placed(x), lambda items: F.when(F.size(items) > 0, _walk(items, none, step)).otherwise(none)))
    return F.when(text.rlike(GUARD[kind, strict]), walked).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(d)), F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, F.substr(d, i, F.lit(1)).cast("int")).otherwise(
            F.get(F.array(*(F.lit(2 * k // 10 + 2 * k % 10) for k in range(10))), F.substr(d, i, F.lit(1)).cast("int"))
        ),
    )
    return (F.length(d) > 0) & (total % 10 == 0)


def _byte_parts(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int"), F.lit(999)) <= 255))


def _passes(kind: str, m: Column) -> Column:
    """The strict form's own checks."""
    n = F.length(_digits(m))
    return {
        "email": F.lit(True),
        "ip": _byte_parts(m),
        "card": F.when(n.between(16, 19), _luhn(m)).otherwise(False),
        "phone": n.between(8, 15),
    }[kind]


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, "y").when(no, "n").otherwise("-")


def _key(kind: str, x: Column, strict: bool, valid: Column) -> Column:
    """The labelers' votes and the span's length class, as one string."""
    m, n = x["m"], F.length(_digits(x["m"]))
    before = F.lower(x["b"])
    around = F.concat(F.when(x["b"] != "", F.right(x["b"], F.lit(1))).otherwise(" "), x["a"])
    known = {
        "email": m.rlike("(?i)" + DOMAINS),
        "ip": ~m.rlike(r"^(?:0|255|22[4-9]|23[0-9]|24[0-9]|25[0-9])\."),
        "card": m.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6)"),
        "phone": m.rlike(r"^(?:\+(?:1|2[0-9]|3[0-9]|4[0-9]|5[0-9]|6[0-9]|7|8[0-9]|9[0-9])|\(?[2-9])"),
    }[kind]
    sound = {
        "email": F.length(m) <= 254,
        "ip": valid if strict else F.lit(True),
        "card": F.when(n.between(14, 19), _luhn(m)).otherwise(False),
        "phone": n.between(10, 13),
    }[kind]
    form = _vote(valid, ~valid) if strict else F.lit("-")
    size = F.least(F.floor(F.length(m) / 8), F.lit(4)).cast("string")
    return F.concat(
        F.lit(kind[0]), F.lit("s" if strict else "w"), size, form, _vote(known, ~known),
        _vote(before.rlike(CUES[kind]), before.rlike(AGAINST)), _vote(sound, ~sound),
        _vote(around.rlike(r"^[\s(\[<\"':,;][\s)\]>\"'.,;:!?]?$"), around.rlike(r"^[\p{L}\p{N}]|[\p{L}\p{N}]$")),
    )


def _candidate(k: int, strict: bool) -> Callable[[Column], Column]:
    kind = KINDS[k]

    def made(x: Column) -> Column:
        valid = _passes(kind, x["m"]) if strict else F.lit(False)
        return F.struct(
            F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"), valid.alias("base"), _key(kind, x, strict, valid).alias("key")
        )

    return made


def candidates(docs: DataFrame) -> DataFrame:
    """docs with _spans: array<struct<k, s, e, base, key>>, strict and wider candidates of all kinds.

    k is the kind's place in KINDS. Of strict matches that fail their checks only those as long as
    a span could be are kept, as the classifier's counterexamples."""
    text = F.coalesce("text", F.lit(""))
    parts = []
    for k, kind in enumerate(KINDS):
        for strict in (True, False):
            found = _found(text, kind, strict)
            if strict and kind == "card":
                found = F.filter(found, lambda x: F.length(_digits(x["m"])) >= 8)

            parts.append(F.transform(found, _candidate(k, strict)))
    return docs.withColumn("_spans", F.concat(*parts))


def _em(votes: np.ndarray, n: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Each pattern's probability of being a span; votes in {0: no, 1: nothing, 2: yes}."""
    p = np.clip((votes == 2).sum(1) / np.maximum((votes != 1).sum(1), 1), 0.05, 0.95)
    for _ in range(rounds):
        share = np.clip((n * p).sum() / n.sum(), 1e-3, 1 - 1e-3)
        yes, no = np.full(len(n), np.log(share)), np.full(len(n), np.log(1 - share))
        for j in range(votes.shape[1]):
            for v in range(3):
                at = votes[:, j] == v
                # two pseudo-counts keep a labeler right more often than not
                prior = (2.0, 1.0, 0.5)
                a = ((n * p)[at].sum() + prior[2 - v]) / ((n * p).sum() + 3.5)
                b = ((n * (1 - p))[at].sum() + prior[v]) / ((n * (1 - p)).sum() + 3.5)
                yes[at] += np.log(a)
                no[at] += np.log(b)
        p = 1 / (1 + np.exp(np.clip(no - yes, -30, 30)))
    return p


def _classifier(keys: list[str], n: np.ndarray, p: np.ndarray) -> dict[str, float]:
    """A logistic classifier of all kinds' patterns, trained on probabilities; its value for each."""
    parts = [[f"{i}{c}" for i, c in enumerate(k)] + [f"{k[0]}{i}{c}" for i, c in enumerate(k) if i > 2] for k in keys]
    at = {f: i for i, f in enumerate(sorted({f for x in parts for f in x}))}
    x = np.zeros((len(keys), len(at)))
    for r, fs in enumerate(parts):
        x[r, [at[f] for f in fs]] = 1
    w, weight = np.zeros(len(at)), np.log1p(n)
    for _ in range(40):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        bend = (x * (weight * q * (1 - q) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(bend, x.T @ (weight * (q - p)) + 0.1 * w)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-7:
            break
    return dict(zip(keys, 1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), strict=True))


def trained(spans: DataFrame) -> dict[str, float]:
    """Probability for each pattern among all candidates of the table."""
    rows = spans.select(F.explode("_spans.key").alias("key")).groupBy("key").agg(F.count("*").alias("n")).orderBy("key").collect()
    if not rows:
        return {}
    keys, n = [r.key for r in rows], np.array([float(r.n) for r in rows])
    votes = np.array([["n-y".index(c) for c in k[3:]] for k in keys])
    p = np.zeros(len(keys))
    for kind in {k[0] for k in keys}:
        own = np.array([k[0] == kind for k in keys])
        p[own] = _em(votes[own], n[own])
    return _classifier(keys, n, p)


def find_pii(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """docs with _all: array<struct<k, s, e, base>>, every span by kind and place."""
    made = candidates(docs)
    found = materialise(made if with_text else made.drop("text"), "candidates")
    good = sorted(k for k, p in trained(found).items() if p >= KEPT and k[1] == "w")
    spans = F.col("_spans")
    said = F.filter(spans, lambda x: ~x["base"] & x["key"].isin(good)) if good else F.array().cast(found.schema["_spans"].dataType)
    base = F.filter(spans, lambda x: x["base"])
    free = F.filter(said, lambda x: ~F.exists(base, lambda y: (y["k"] == x["k"]) & (y["s"] < x["e"]) & (x["s"] < y["e"])))
    return found.withColumn("_all", F.array_sort(F.transform(F.concat(base, free), lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["base"].alias("base"))))).drop("_spans")


def _told(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("_all", lambda x: x["base"])
    out = found.drop(*REDUNDANT)
    for k, kind in enumerate(KINDS):
        own = F.filter(F.transform(base, lambda x: x["k"]), F.lit(k).__eq__)
        out = out.withColumn(f"n_{kind}", F.size(own).cast("long"))
    return out.withColumn("base_sha256", F.sha2(_told(base), 256)).withColumn("spans", _told(F.col("_all"))).drop("_all")


def _cut(blocks: Column, a: Column, b: Column) -> Column:
    """Code points a to b of a text that is given in blocks."""
    first, last = F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")
    head = F.substr(F.get(blocks, first), a - first * BLOCK + 1, F.least(b - a, F.lit(BLOCK)))
    tail = F.substr(F.get(blocks, last), F.lit(1), b - last * BLOCK)
    middle = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    return F.when(b <= a, "").when(first == last, head).otherwise(F.concat(head, middle, tail))


def redact(found: DataFrame) -> DataFrame:
    """found with each span in text replaced by its kind in angle brackets, the earlier and longer
    span first where kinds overlap; n_chars, where there is such a column, follows the text."""
    kinds = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    order = F.array_sort(F.transform("_all", lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["k"].alias("k"))))
    none = F.array().cast("array<struct<a:int,s:int,e:int,k:int>>")

    def step(acc: Column, x: Column) -> Column:
        told = F.struct(acc["at"].alias("a"), x["s"].alias("s"), (-x["e"]).alias("e"), x["k"].alias("k"))
        return F.when(x["s"] >= acc["at"], F.struct((-x["e"]).alias("at"), F.concat(acc["own"], F.array(told)).alias("own"))).otherwise(acc)

    taken = F.when(F.size("_all") > 0, F.struct(_walk(order, none, step).alias("cuts"), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)).alias("blocks")))
    out = found.select("*", F.explode(F.array(taken)).alias("_taken"))  # so that it is computed once
    cuts, blocks = F.col("_taken.cuts"), F.col("_taken.blocks")
    parts = F.transform(cuts, lambda x: F.concat(_cut(blocks, x["a"], x["s"]), F.get(kinds, x["k"])))  # columns by now
    rest = _cut(blocks, F.element_at(cuts, -1)["e"], F.length("text"))
    out = out.withColumn("text", F.when(F.col("_taken").isNotNull(), F.concat(F.array_join(parts, ""), rest)).otherwise(F.col("text"))).drop("_all", "_taken")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(find_pii(docs, with_text=False))
