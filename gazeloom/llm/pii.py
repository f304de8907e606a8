"""Personal data by weak supervision, in DataFrame functions only.

Regular expressions give candidate spans: the base forms, and wider forms that only count if the
rest of the method vouches for them (addresses written with "at" and "dot", phone numbers without
a country code, card numbers with other separators, long-form IPv6 addresses). Five labelers
vote on every candidate (yes, no or nothing): its shape, a gazetteer (domain endings, country
and area codes, card issuers, reserved networks), words of context that speak for or against
it, and the variety of its digits. Votes and features are counted over all texts; expectation-
maximisation on the counts estimates each labeler's reliability and each vote pattern's
probability, and a naive Bayes classifier over features of spans is trained on these
probabilities. Candidates of wider forms are kept where it gives 1/2 or more; base spans stay.

Texts are searched once, in time in proportion to their length and matches; rows are never
exploded beyond candidates, and only tables of counts, bounded by the votes' and features' values,
are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = ("email", "ip", "card", "phone")
EM_ROUNDS = 8
#: Code points before and after a span that are its context; items in a block of a fold.
BEFORE, AFTER, BLOCK = 24, 8, 64
# The base forms; possessive where no other match is possible, so that matching takes time in
# proportion to the text. A match of a local part starts where a run starts or a match ended.
_BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[(\[{] ?at ?[)\]}] ?[A-Za-z0-9-]{1,63}+(?: ?(?:[(\[{] ?dot ?[)\]}]|\.) ?[A-Za-z0-9-]{1,63}+){1,4}+",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9._/])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9._/])",
    "phone": r"(?<![0-9+().-])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-]?[0-9])",
}
# Fixed values of the labelers.
_ENDINGS = r"(?i)(?:\.| |dot[)\]}] ?)(com|org|net|edu|gov|mil|int|io|co|info|biz|de|fr|es|uk|us|ca|it|nl|eu|ch|at|be|mx|ar|br|in|cn|jp|au)$"
_ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|36|38|30[0-5]|35|6011|65|62)"
_RESERVED = r"^(0|127|255|22[4-9]|2[3-5][0-9])\."
_COUNTRIES = r"^\+(1|7|2[07]|3[0-469]|4[0134-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|^\(?[2-9]"
_FOR = {"email": r"mail|contact|write|schreib|écri|correo|@", "ip": r"\bip\b|host|addr|server|from|client", "card": r"card|visa|master|amex|credit|karte|carte|tarjeta", "phone": r"tel|phone|call|mobile|fax|anruf|appel|llam"}
_AGAINST = {"email": r"example|sample", "ip": r"version|build|release|\bv\.?\s*$|section|§", "card": r"isbn|order|invoice|serial|id\s*$|ref", "phone": r"isbn|order|invoice|version|ref|\bpp?\.\s*$"}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _with_prefixes(df: DataFrame, names: list[str], merge: Callable[[Column, Column], Column]) -> DataFrame:
    """df with, for each named array of non-negative ints, an array _pre<name>: of each element, merge
    over those before it (0 before the first). By blocks, so that the work is about in
    proportion to the elements (a fold that gathers all of them copies them at each step)."""
    none = F.array().cast("array<array<int>>")
    fold = lambda xs, get: F.aggregate(xs, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(merge(F.element_at(acc, -1), get(x)))))

    def blocks(name: str) -> Column:
        inside = lambda at: fold(F.slice(F.col(name), at, F.lit(BLOCK)), lambda x: x)
        return F.when(F.size(name) > 0, F.transform(F.sequence(F.lit(1), F.size(name), F.lit(BLOCK)), inside)).otherwise(none)

    def joined(name: str) -> Column:
        own = F.col(f"_blocks{name}")
        before = F.slice(fold(own, lambda block: F.element_at(block, -1)), F.lit(1), F.size(own))
        whole = lambda z: F.transform(F.slice(z["block"], F.lit(1), F.size(z["block"]) - 1), lambda v: merge(z["upto"], v))
        return F.flatten(F.transform(F.arrays_zip(own.alias("block"), before.alias("upto")), whole))

    df = df.withColumns({f"_blocks{name}": blocks(name) for name in names})
    return df.withColumns({f"_pre{name}": joined(name) for name in names}).drop(*[f"_blocks{name}" for name in names])


def _matches(pieces: Column, matches: Column) -> Column:
    """array<struct<gap, n, m, before, after>> of the matches that parted a text into pieces."""
    n = F.size(matches)
    rows = F.arrays_zip(F.slice(pieces, F.lit(1), n).alias("gap"), matches.alias("m"), F.slice(pieces, F.lit(2), n).alias("next"))
    part = lambda r: F.struct(F.length(r["gap"]).alias("gap"), F.length(r["m"]).alias("n"), r["m"].alias("m"), F.right(r["gap"], F.lit(BEFORE)).alias("before"), F.left(r["next"], F.lit(AFTER)).alias("after"))
    return F.transform(rows, part)


def _placed(name: str) -> Column:
    """array<struct<s, e, m, before, after>>: code points, end exclusive."""
    place = lambda z: F.struct((z["upto"] + z["r"]["gap"]).alias("s"), (z["upto"] + z["r"]["gap"] + z["r"]["n"]).alias("e"), z["r"]["m"].alias("m"), z["r"]["before"].alias("before"), z["r"]["after"].alias("after"))
    return F.transform(F.arrays_zip(F.col(f"_r_{name}").alias("r"), F.col(f"_pre_l_{name}").alias("upto")), place)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(_digits(m)).between(13, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _wide_valid(kind: str, m: Column) -> Column:
    return F.call_function("luhn_check", _digits(m)) if kind == "card" else F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, 2).when(yes, 1).otherwise(0)


def _judged(kind: str, wide: bool, c: Column) -> Column:
    """A candidate with its votes and features."""
    m, before, digits = c["m"], F.lower(c["before"]), _digits(c["m"])
    never = F.lit(False)
    shape = _vote(F.lit(not wide), never)
    gazetteer = {"email": _vote(m.rlike(_ENDINGS), ~m.rlike(_ENDINGS)), "ip": _vote(F.lit(False), m.rlike(_RESERVED)), "card": _vote(digits.rlike(_ISSUERS), ~digits.rlike(_ISSUERS)), "phone": _vote(m.rlike(_COUNTRIES), ~m.rlike(_COUNTRIES))}[kind]
    varied = F.size(F.array_distinct(F.split(digits, "")))
    variety = _vote(varied >= 5, varied <= 2) if kind in ("card", "phone") else _vote(never, never)
    edge = F.when(c["before"] == "", 0).when(c["before"].rlike(r"[A-Za-z0-9]$"), 1).when(c["before"].rlike(r"\s$"), 2).otherwise(3)
    behind = F.when(c["after"] == "", 0).when(c["after"].rlike(r"^[A-Za-z0-9]"), 1).when(c["after"].rlike(r"^\s"), 2).otherwise(3)
    return F.struct(
        c["s"].alias("s"), c["e"].alias("e"),
        shape.alias("v0"), gazetteer.alias("v1"), _vote(before.rlike(_FOR[kind]), never).alias("v2"), _vote(never, before.rlike(_AGAINST[kind])).alias("v3"), variety.alias("v4"),
        F.lit(int(wide)).alias("f0"), F.least(F.length(digits), F.lit(20)).alias("f1"), F.least(F.floor(F.length(m) / 4).cast("int"), F.lit(12)).alias("f2"), edge.alias("f3"), behind.alias("f4"),
    )


_VOTES, _FEATURES = ("v0", "v1", "v2", "v3", "v4"), ("f0", "f1", "f2", "f3", "f4")


def _each(fn: Callable[..., Column], kind: object) -> Callable[[Column], Column]:
    """fn of a kind as a function of a candidate alone, as Spark's functions on arrays want it."""
    return lambda c: fn(kind, c)


def candidates(docs: DataFrame, keep: tuple[str, ...] | None = None) -> DataFrame:
    """docs (with `keep`, only these columns) with, for each kind, its base spans (_base_<kind>) and its wide candidates that
    overlap none of them (_wide_<kind>). Written: a text is searched once."""
    out = docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    has = lambda pattern: F.col("_text").rlike(pattern)
    may = {"email": F.contains("_text", F.lit("@")), "ip": has("[0-9]"), "card": has("[0-9]"), "phone": F.contains("_text", F.lit("+"))}
    wide_may = {"email": has("[(\\[{] ?at"), "ip": has("[0-9A-Fa-f]:[0-9A-Fa-f]"), "card": has("[0-9]{4}[._/][0-9]"), "phone": has("[0-9][.)-]")}
    searches = [("base", k, _BASE[k], may[k]) for k in KINDS] + [("wide", k, _WIDE[k], wide_may[k]) for k in KINDS]
    none = F.array().cast("array<string>")
    parted = {}
    for what, k, pattern, there in searches:
        parted[f"_p_{what}_{k}"] = F.when(there, F.split("_text", pattern, -1)).otherwise(none)
        parted[f"_m_{what}_{k}"] = F.when(there, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).otherwise(none)
    out = out.withColumns(parted)
    # Each step is a projection of its own, or each use of a list would make it again.
    names = [f"{what}_{k}" for what, k, *_ in searches]
    out = out.withColumns(parted).withColumns({f"_r_{x}": _matches(F.col(f"_p_{x}"), F.col(f"_m_{x}")) for x in names})
    out = out.withColumns({f"_l_{x}": F.transform(f"_r_{x}", lambda r: r["gap"] + r["n"]) for x in names})
    out = _with_prefixes(out, [f"_l_{x}" for x in names], lambda a, b: a + b)
    judged = {}
    for what, k, *_ in searches:
        wide, valid = what == "wide", _wide_valid if what == "wide" else _valid
        hits = F.filter(_placed(f"{what}_{k}"), _each(lambda kw, c, valid=valid: valid(kw, c["m"]), k))
        judged[f"_{what}_{k}"] = F.transform(hits, _each(lambda kw, c, wide=wide: _judged(kw, wide, c), k))
    out = out.withColumns(judged).drop(*[f"_{x}_{y}" for x in ("p", "m", "r", "l", "pre_l") for y in names])
    # Wide candidates and all base spans by start: the furthest end of a base span before, and the next base span's start.
    taken = F.concat(*[F.transform(f"_base_{k}", lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e"), F.lit(0).alias("wide"))) for k in KINDS])
    every = lambda k: F.array_sort(F.concat(taken, F.transform(f"_wide_{k}", lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), F.lit(1).alias("wide")))))
    out = out.withColumns({f"_o_{k}": F.when(F.size(f"_wide_{k}") > 0, every(k)).otherwise(F.array()) for k in KINDS})
    far = 2**31 - 1
    out = out.withColumns({f"_e_{k}": F.transform(f"_o_{k}", lambda x: F.when(x["wide"] == 0, x["e"]).otherwise(0)) for k in KINDS})
    out = out.withColumns({f"_b_{k}": F.transform(F.reverse(f"_o_{k}"), lambda x: F.when(x["wide"] == 0, far - x["s"]).otherwise(0)) for k in KINDS})
    out = _with_prefixes(out, [f"_{x}_{k}" for x in "eb" for k in KINDS], F.greatest)
    clear = {}
    for k in KINDS:
        rows = F.arrays_zip(F.col(f"_o_{k}").alias("x"), F.col(f"_pre_e_{k}").alias("end"), F.reverse(f"_pre_b_{k}").alias("next"))
        rows = F.filter(rows, lambda z: z["x"]["wide"] == 1)  # as many as candidates, in their order
        pairs = F.arrays_zip(F.col(f"_wide_{k}").alias("c"), rows.alias("z"))
        free = F.filter(pairs, lambda p: (p["z"]["end"] <= p["c"]["s"]) & (far - p["z"]["next"] >= p["c"]["e"]))
        clear[f"_wide_{k}"] = F.when(F.size(f"_wide_{k}") > 0, F.transform(free, lambda p: p["c"])).otherwise(F.col(f"_wide_{k}"))
    out = out.withColumns(clear)
    return cut(out.select(*(docs.columns if keep is None else keep), *[f"_{what}_{k}" for what in ("base", "wide") for k in KINDS]), "candidates")


def _logit(p: Column | float):
    return math.log(p / (1 - p)) if isinstance(p, float) else F.ln(p / (1 - p))


def train(found: DataFrame) -> dict:
    """The classifier's log-odds: {kind: (prior, {feature: {value: log-odds}})}. The rows that
    reach the driver are labeler and feature values, some hundreds whatever the input."""
    each = F.concat(*[F.transform(F.concat(f"_base_{k}", f"_wide_{k}"), _each(lambda i, c: F.struct(F.lit(i).alias("kind"), *[c[x].alias(x) for x in (*_VOTES, *_FEATURES)]), i)) for i, k in enumerate(KINDS)])
    counts = found.select(F.explode(each).alias("c")).select("c.*").groupBy("kind", *_VOTES, *_FEATURES).agg(F.count("*").alias("n"))
    counts = cut(counts.coalesce(1), "votes")
    patterns = counts.groupBy("kind", *_VOTES).agg(F.sum("n").alias("n")).collect()  # 3 ** 5 patterns a kind at most
    rates = {k: (0.5, [0.8] * len(_VOTES)) for k in range(len(KINDS))}

    def posterior() -> Column:
        branches = F
        for k, (prior, right) in rates.items():
            logit = F.lit(_logit(prior))
            for v, a in zip(_VOTES, right):
                logit = logit + F.when(F.col(v) == 1, _logit(a)).when(F.col(v) == 2, -_logit(a)).otherwise(0.0)
            branches = branches.when(F.col("kind") == k, 1 / (1 + F.exp(-logit)))
        return branches

    clip = lambda x: min(0.99, max(0.01, x))
    for _ in range(EM_ROUNDS):
        for k, (prior, right) in rates.items():
            own = [(r[1 : 1 + len(_VOTES)], r["n"]) for r in patterns if r["kind"] == k]
            logit = [_logit(prior) + sum(_logit(a) * (1 if v == 1 else -1) for v, a in zip(votes, right) if v) for votes, _ in own]
            p = [1 / (1 + math.exp(-x)) for x in logit]
            total, yes = sum(n for _, n in own), sum(q * n for q, (_, n) in zip(p, own))
            better = []
            for i in range(len(_VOTES)):  # agreement of the vote with the estimate, over its votes
                agreed = sum((q if votes[i] == 1 else 1 - q) * n for q, (votes, n) in zip(p, own) if votes[i])
                voted = sum(n for votes, n in own if votes[i])
                better.append(max(0.5, clip((agreed + 4.0) / (voted + 5.0))))  # as if 4 of 5 more votes were right
            rates[k] = (clip((yes + 1.0) / (total + 2.0)), better)
    soft = counts.withColumn("_p", posterior())
    values = soft.select("kind", (F.col("_p") * F.col("n")).alias("yes"), ((1 - F.col("_p")) * F.col("n")).alias("no"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("int").alias("value")) for f in _FEATURES])).alias("x"))
    rows = values.groupBy("kind", "x.feature", "x.value").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect()  # a row a feature's value
    model = {}
    for k in range(len(KINDS)):
        own = [r for r in rows if r[0] == k]
        yes = sum(r[3] for r in own) / len(_FEATURES)
        no = sum(r[4] for r in own) / len(_FEATURES)
        table: dict[str, dict[int, float]] = {f: {} for f in _FEATURES}
        for r in own:
            table[r[1]][r[2]] = math.log((r[3] + 1) / (yes + 10)) - math.log((r[4] + 1) / (no + 10))
        model[KINDS[k]] = (math.log((yes + 1) / (no + 1)), table)
    return model


def _logodds(kind: str, c: Column, model: dict) -> Column:
    prior, table = model[kind]
    out = F.lit(float(prior))
    for f, values in table.items():
        if values:
            m = F.create_map(*[x for v, w in values.items() for x in (F.lit(v), F.lit(float(w)))])
            out = out + F.coalesce(F.element_at(m, c[f].cast("int")), F.lit(0.0))
    return out


def spans(docs: DataFrame, keep: tuple[str, ...] | None = None) -> DataFrame:
    """docs (with `keep`, only these columns) with _base and _all: array<struct<k, s, e>> of the base spans and of all spans, by
    kind as listed, then start. Null and empty texts have none. Every
    row stands for itself; an empty table gives an empty result."""
    found = candidates(docs, keep)
    model = train(found)
    plain = lambda name, i: F.transform(name, lambda c: F.struct(F.lit(i).alias("k"), c["s"].alias("s"), c["e"].alias("e")))
    base = F.concat(*[plain(f"_base_{k}", i) for i, k in enumerate(KINDS)])
    kept = [F.filter(f"_wide_{k}", _each(lambda k, c: _logodds(k, c, model) >= 0, k)) for k in KINDS]
    found = found.withColumns({f"_kept_{k}": x for k, x in zip(KINDS, kept)})
    every = F.array_sort(F.concat(base, *[plain(f"_kept_{k}", i) for i, k in enumerate(KINDS)]))
    kept_columns = docs.columns if keep is None else list(keep)
    return found.withColumns({"_base": base, "_all": every}).select(*kept_columns, "_base", "_all")


def _joined(column: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(column, lambda c: F.concat_ws(":", F.element_at(names, c["k"] + 1), c["s"].cast("string"), c["e"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_<kind> of base spans, base_sha256 and spans for every row."""
    found = spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), keep=("doc_id",))
    count = [F.size(F.filter("_base", _each(lambda i, c: c["k"] == i, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *count, F.sha2(_joined("_base").cast("binary"), 256).alias("base_sha256"), _joined("_all").alias("spans"))


def mask(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by its kind, as [EMAIL]; overlapping spans become
    the first one's mark. Other columns stay; n_chars, if there, counts the new text. A null
    text stays null."""
    found = spans(docs.select(F.struct(*docs.columns).alias("_doc"), F.col("text").cast("string").alias("text")))  # columns may have any names
    order = F.array_sort(F.transform("_all", lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["k"].alias("k"))))
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    # Spans that overlap become the first one's mark; what is between marks stays.
    found = found.withColumn("_order", order).withColumn("_e", F.transform("_order", lambda c: c["e"]))
    found = _with_prefixes(found, ["_e"], F.greatest)
    cuts = F.transform(F.arrays_zip(F.col("_order").alias("c"), F.col("_pre_e").alias("a")), lambda z: F.struct(z["a"].alias("a"), z["c"]["s"].alias("s"), z["c"]["k"].alias("k")))
    found = found.withColumn("_cuts", F.filter(cuts, lambda c: c["s"] >= c["a"]))
    piece = lambda c: F.concat(F.substr(F.col("text"), c["a"] + 1, c["s"] - c["a"]), F.element_at(marks, c["k"] + 1))
    tail = F.substr(F.col("text"), F.array_max(F.transform("_all", lambda c: c["e"])) + 1)
    text = F.when(F.size("_cuts") > 0, F.concat(F.array_join(F.transform("_cuts", piece), ""), tail)).otherwise(F.col("text"))
    own = {"text": F.col("text"), "n_chars": F.when(F.col("text").isNull(), F.col("_doc.n_chars")).otherwise(F.length("text"))} if "n_chars" in docs.columns else {"text": F.col("text")}
    kinds = dict(docs.dtypes)
    return found.withColumn("text", text).select(*[own[c].cast(kinds[c]).alias(c) if c in own else F.col("_doc").getField(c).alias(c) for c in docs.columns])
