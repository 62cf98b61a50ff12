"""Personal data by weak supervision, with DataFrame functions only.

Patterns propose spans. Four labelers (format, gazetteer, context, delimiters) vote on each, or
abstain. Expectation-maximisation over the counts of vote patterns, a bounded table, estimates how
far each labeler can be trusted on each kind; the posteriors then train a naive Bayes classifier over the votes
and the span's shape, which decides on the proposals that the base rules don't settle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Possessive forms match the same texts without deep recursion.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Kinds that only the method proposes: credentials, names after a form of address, and what the base patterns leave
#: out of their own kinds: addresses with the signs spelled out, numbers without a country code, IPv6, short cards, accounts.
MORE = {
    "secret": r"\b(?:AKIA[0-9A-Z]{16}|(?i:password|passwd|pwd|token|secret|api_?key)\x20{0,3}[=:]\x20{0,3}[\x22\x27]?[A-Za-z0-9+/_-]{6,}+)",
    "name": r"\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20\p{Lu}\p{Ll}{1,20}(?:\x20\p{Lu}\p{Ll}{1,20})?",
    "email_written": r"(?i)\b[a-z0-9._%+-]{2,64}(?:\x20?[(\[]at[)\]]\x20?[a-z0-9-]{2,63}(?:(?:\x20?[(\[]dot[)\]]\x20?|\x20dot\x20|\.)[a-z]{2,24})+|\x20at\x20[a-z0-9-]{2,63}(?:\x20dot\x20[a-z]{2,24})+)",
    "phone_national": r"(?<![0-9+.,/-])(?:\([0-9]{2,5}\)\x20?|[0-9]{3,5}[\x20./-])[0-9]{3,4}[\x20.-][0-9]{3,5}(?![0-9])(?![.,/-][0-9])",
    "ip6": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card_short": r"(?<![0-9])3[0-9]{3}[\x20-]?[0-9]{6}[\x20-]?[0-9]{4,5}(?![0-9])",
    "account": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?\b",
}
#: Any of these a text must hold before a pattern is tried at all.
_QUICK = {"email": ("@",), "ip": (".",), "phone": ("+",), "name": (" ",), "email_written": ("(at)", "[at]", " dot ", "(AT)", "[AT]"), "ip6": (":",)}
#: Gazetteers: endings of mail domains, first digits of card issuers, country codes, key prefixes, first names, account countries.
GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$",
    "ip": r"^(?:10|127|169|172|192|[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])\.",
    "card": r"^(?:3[47]|4|5[1-5]|2[2-7]|6)",
    "phone": r"^\+(?:1|7|2[07]|3[0-46-9]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "secret": r"AKIA|[0-9a-f]{12}",
    "name": r"\x20(?:Anna|Maria|John|James|Mary|Peter|Paul|Hans|Klaus|Pierre|Marie|Jean|Carlos|Juan|Luis|Sarah|David|Michael)\b",
    "email_written": r"(?i)(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$",
    "phone_national": r"^\(?(?:0[1-9]|[2-9][0-9]{2}\b)",
    "ip6": r"(?i)^(?:2[0-9a-f]{3}|fe80|f[cd][0-9a-f]{2}):",
    "card_short": r"^3(?:[47]|0[0-5]|[68])",
    "account": r"^(?:AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)",
}
#: Context words before a span that speak for its kind.
CONTEXT = {
    "email": r"(?i)(?:e-?mail|contact|write|mailto)[^A-Za-z0-9]*$",
    "ip": r"(?i)(?:\bip|host|address|server|from)[^A-Za-z0-9]*$",
    "card": r"(?i)(?:card|visa|mastercard|credit|carte|karte|tarjeta)[^A-Za-z0-9]*$",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax)[^A-Za-z0-9]*$",
    "secret": r"(?i)(?:login|user|key|secret|credentials?)[^A-Za-z0-9]*$",
    "name": r"(?i)(?:dear|by|from|with|contact)[^A-Za-z0-9]*$",
    "account": r"(?i)(?:iban|account|konto|compte|cuenta)[^A-Za-z0-9]*$",
}
CONTEXT |= {"email_written": CONTEXT["email"], "phone_national": CONTEXT["phone"], "ip6": CONTEXT["ip"], "card_short": CONTEXT["card"]}
#: Words before a number that speak against it.
_AGAINST = r"(?i)(?:version|v|section|chapter|page|isbn|order)\.?\x20*$"
LABELERS = ("format", "gazetteer", "context", "edges")
ROUNDS = 12

_SPANS = "array<struct<kind:string,start:int,stop:int,body:string,before:string,after:string>>"


def _proposals(kind: str, m: Column, p: Column) -> Column:
    """Matches ``m`` and the pieces ``p`` between them, as spans with code point offsets."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))
    both = F.transform(m, lambda x, i: F.struct(x.alias("m"), F.get(p, i).alias("p"), F.get(p, i + 1).alias("q")))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + F.length(x["p"])
        last = first + F.length(x["m"])
        span = F.struct(
            F.lit(kind).alias("kind"), first.alias("start"), last.alias("stop"), x["m"].alias("body"),
            F.substring(x["p"], -24, 24).alias("before"), F.substring(x["q"], 1, 8).alias("after"),
        )
        return F.struct(last.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    return F.aggregate(both, start, step, lambda acc: acc["spans"])


def _luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check; each second one from the right is doubled."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + worth(i))
    return total % 10 == 0


def _remainder_97(body: Column) -> Column:
    """An account number, its first four signs moved to the end and letters as 10 to 35, modulo 97."""
    plain = F.regexp_replace(body, " ", "")
    moved = F.concat(F.substring(plain, 5, 99), F.substring(plain, 1, 4))
    code = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda acc, c: (acc * F.when(code(c) > 9, 100).otherwise(10) + code(c)) % 97)


def _valid(kind: Column, body: Column) -> Column:
    """The base rules' check of a match, and the check digits of short cards and accounts; other kinds of the
    method's own always pass it."""
    digits = F.regexp_replace(body, "[^0-9]", "")
    parts = F.transform(F.split(body, r"\."), lambda x: F.regexp_replace(x, "^0+", ""))
    ip = F.forall(parts, lambda x: (F.length(x) < 3) | ((F.length(x) == 3) & (x <= "255")))
    card = F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    short = F.when(F.length(digits).between(14, 15), _luhn(digits)).otherwise(False)
    return (
        F.when(kind == "ip", ip).when(kind == "card", card)
        .when(kind == "phone", F.length(digits).between(8, 15)).when(kind == "phone_national", F.length(digits).between(9, 12))
        .when(kind == "card_short", short).when(kind == "account", _remainder_97(body) == 1).otherwise(True)
    )


def _by_kind(kind: Column, table: dict[str, str], text: Column) -> Column:
    out = F.lit(False)
    for k, pattern in table.items():
        out = F.when(kind == k, text.rlike(pattern)).otherwise(out)
    return out


def _votes(s: Column) -> dict[str, Column]:
    """1 for, 0 against, -1 abstains."""
    digits = F.length(F.regexp_replace(s["body"], "[^0-9]", ""))
    shape = (
        F.when(s["kind"] == "secret", s["body"].rlike(r"AKIA|[0-9]")).when(s["kind"] == "card", s["valid"] & digits.isin(16, 19))
        .when(s["kind"] == "phone", s["valid"] & s["body"].rlike(r"[\x20().-]")).otherwise(s["valid"])
    )
    clean = ~s["before"].rlike(r"[A-Za-z0-9_/=.-]$") & ~s["after"].rlike(r"^[A-Za-z0-9_/=-]")
    return {
        "format": shape.cast("int"),
        "gazetteer": F.when(_by_kind(s["kind"], GAZETTEER, s["body"]), 1).when(s["kind"] == "name", -1).otherwise(0),
        "context": F.when(_by_kind(s["kind"], CONTEXT, s["before"]), 1).when(s["before"].rlike(_AGAINST), 0).otherwise(-1),
        "edges": clean.cast("int"),
    }


def _size(s: Column) -> Column:
    """The span's length, in five steps."""
    n = s["stop"] - s["start"]
    return F.when(n < 8, 0).when(n < 14, 1).when(n < 17, 2).when(n < 25, 3).otherwise(4)


def proposals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, spans)``: all proposed spans of each row, with their votes."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    patterns = BASE | MORE
    for kind, pattern in patterns.items():
        quick = F.lit(kind not in _QUICK)
        for held in _QUICK.get(kind, ()):
            quick = quick | F.col("t").contains(held)
        d = d.withColumn(f"m_{kind}", F.when(quick, F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    for kind, pattern in patterns.items():
        d = d.withColumn(f"p_{kind}", F.when(F.size(f"m_{kind}") > 0, F.split("t", pattern, -1)).otherwise(F.array().cast("array<string>")))
    spans = F.concat(*(_proposals(k, F.col(f"m_{k}"), F.col(f"p_{k}")) for k in patterns))
    d = d.select("doc_id", spans.alias("spans"))
    d = d.withColumn("spans", F.transform("spans", lambda s: s.withField("valid", _valid(s["kind"], s["body"]))))
    return d.withColumn(
        "spans",
        F.transform("spans", lambda s: F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["valid"].alias("valid"),
            *(v.cast("int").alias(k) for k, v in _votes(s).items()), _size(s).alias("size"),
        )),
    )


def train(proposed: DataFrame) -> dict:
    """Log-odds of the span classifier: ``{(kind, feature, value): weight}`` and ``{kind: prior}``.

    The counts per kind, votes and size are a table of a bounded size (kinds x 3^4 x 5); each round
    of EM is one aggregate over it, whose few numbers become the next round's constants.
    """
    patterns = materialize(
        proposed.select(F.explode("spans").alias("s")).groupBy("s.kind", *(f"s.{x}" for x in (*LABELERS, "size")))
        .agg(F.count("*").cast("double").alias("n")).coalesce(1)
    )
    kinds = (*KINDS, *MORE)
    prior = dict.fromkeys(kinds, 0.5)
    # P(vote 1 | truth 1) and P(vote 1 | truth 0), by kind and labeler; all start as better than chance.
    hit, miss = ({k: dict.fromkeys(LABELERS, p) for k in kinds} for p in (0.8, 0.3))

    def truth() -> Column:
        out = F.lit(0.0)
        for k in kinds:
            odds = F.lit(_log(prior[k] / (1 - prior[k])))
            for x in LABELERS:
                h, m = hit[k][x], miss[k][x]
                odds += F.when(F.col(x) == 1, _log(h / m)).when(F.col(x) == 0, _log((1 - h) / (1 - m))).otherwise(0.0)
            out = F.when(F.col("kind") == k, odds).otherwise(out)
        return 1 / (1 + F.exp(-out))

    clip = lambda x: min(max(x, 0.02), 0.98)
    for _ in range(ROUNDS):
        q = patterns.withColumn("q", truth())
        yes, no = F.col("q") * F.col("n"), (1 - F.col("q")) * F.col("n")
        sums = [F.sum(yes).alias("yes"), F.sum("n").alias("all")]
        for x in LABELERS:
            for name, w in (("yes", yes), ("no", no)):
                sums += [F.sum(F.when(F.col(x) == 1, w).otherwise(0.0)).alias(f"{x}_{name}_1"), F.sum(F.when(F.col(x) >= 0, w).otherwise(0.0)).alias(f"{x}_{name}_all")]
        told = {r["kind"]: r for r in q.groupBy("kind").agg(*sums).collect()}  # a row per kind
        for k, r in told.items():
            prior[k] = clip((r["yes"] + 1) / (r["all"] + 2))
            for x in LABELERS:
                hit[k][x] = clip((r[f"{x}_yes_1"] + 4) / (r[f"{x}_yes_all"] + 5))
                miss[k][x] = min(clip((r[f"{x}_no_1"] + 1) / (r[f"{x}_no_all"] + 4)), hit[k][x])  # no labeler votes against the truth
    q = patterns.withColumn("q", truth())
    weights, features = {}, (*LABELERS, "size")
    for x in features:
        found = q.groupBy("kind", x).agg(F.sum(F.col("q") * F.col("n")).alias("yes"), F.sum((1 - F.col("q")) * F.col("n")).alias("no")).collect()
        for k in kinds:
            mine = [r for r in found if r["kind"] == k]
            yes, no, m = sum(r["yes"] for r in mine), sum(r["no"] for r in mine), max(len(mine), 1)
            for r in mine:
                weights[k, x, r[x]] = float(_log((r["yes"] + 1) / (yes + m)) - _log((r["no"] + 1) / (no + m)))
    return {"prior": prior, "weights": weights, "hit": hit, "miss": miss}


def _log(x: float) -> float:
    import math

    return math.log(x)


def _score(s: Column, model: dict) -> Column:
    out = F.lit(0.0)
    for k, p in model["prior"].items():
        out = F.when(s["kind"] == k, F.lit(_log(p / (1 - p)))).otherwise(out)
    for (k, x, value), w in model["weights"].items():
        out += F.when((s["kind"] == k) & (s[x] == value), F.lit(w)).otherwise(0.0)
    return out


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, base, spans)``: arrays of ``(kind, start, stop)``, a row for each row of ``docs``.

    ``base`` are the base rules' spans, in the order of ``KINDS`` and then start; ``spans`` are those
    and what the method adds: proposals of its own kinds that the classifier accepts and that overlap
    no base span. Offsets are code points, ends exclusive. A null text is empty; null ids and
    repeated rows are carried along; an empty table gives an empty result; other columns are ignored.
    """
    proposed = materialize(proposals(docs, id_col, text_col))
    model = train(proposed)
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS) & s["valid"])
    with_base = proposed.withColumn("base", base)
    added = F.filter(
        "spans",
        lambda s: s["kind"].isin(*MORE) & (_score(s, model) > 0)
        & s["valid"] & ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])),
    )
    brief = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))
    return with_base.select("doc_id", F.transform("base", brief).alias("base"), F.transform(F.concat("base", added), brief).alias("spans"))


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` of :func:`find_spans`."""
    found = find_spans(docs)
    of_kind = lambda kind: F.filter("base", lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))
