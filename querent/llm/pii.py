"""Personal data by weak supervision, in DataFrame functions alone.

Patterns find candidate spans of each kind. Labelers vote on each: its checksum or form (regex), known names,
domains and prefixes (gazetteer), and the words before it (context). Expectation-maximisation over the table
of vote patterns estimates how reliable each labeler is; the posteriors it gives train a logistic
classifier over kinds, votes and shapes, which accepts or drops the candidates of kinds beyond the base ones. Base
spans that pass their own test always stay.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base kinds, in their order.
BASE = ("email", "ip", "card", "phone")
#: Kinds that the method adds, listed after the base ones: a phone number without its +, a national id, a name after a title, an account number, a key or password.
ADDED = ("local", "natid", "name", "iban", "secret")
KINDS = BASE + ADDED
_EMAIL = "A-Za-z0-9._%+-"
#: As the base patterns, written so that a match takes linear time and no deep recursion: a run is entered at
#: its first character or where the last match ended, and is not given back.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_EMAIL}]))[{_EMAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local": r"(?<![0-9+(.-])(?<!\+[0-9] )\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "natid": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? \p{Lu}\p{Ll}{1,30}+(?: \p{Lu}\p{Ll}{1,30}+){0,2}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}",
}
#: A text without this character can't match.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+", "local": "", "natid": "-", "name": " ", "iban": "", "secret": ""}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Words before a span that speak for its kind, and words that speak against any; whole words all of them.
CUES = {
    "email": r"\b(?:e-?mail|mail|contact|write|reach|address)\b",
    "ip": r"\b(?:ip|host|server|login|client|address|from)\b",
    "card": r"\b(?:card|visa|master|credit|debit|pay|amex)\b",
    "phone": r"\b(?:tel|phone|call|mobile|fax|contact|reach|ring)\b",
    "local": r"\b(?:tel|phone|call|mobile|fax|contact|reach|ring)\b",
    "natid": r"\b(?:ssn|social|security|insurance|tax|passport|identity)\b",
    "name": r"\b(?:name|contact|dear|signed|from|by|attn)\b",
    "iban": r"\b(?:iban|bank|account|transfer|konto)\b",
    "secret": r"(?:password|passwd|pwd|secret|token|bearer|auth|key)[\"']?\s{0,3}[=:]?\s{0,3}[\"']?$",
}
AGAINST = r"\b(?:hash|sha[0-9]*|md5|commit|version|build|isbn|order|invoice|serial|uuid|checksum|page|vol)\b|[/.]$"
#: Known beginnings and endings: mail domains, card issuers, exchanges, countries, given names.
GAZETTEER = {
    "email": r"(?i)[@.](?:example\.(?:com|org|net)|gmail\.com|outlook\.com|yahoo\.com|hotmail\.com)$",
    "ip": r"^(?:10|127|169|172|192|[1-9][0-9]?|1[0-9]{2}|2[01][0-9]|22[0-3])\.",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^\+(?:1|33|34|39|4[0-9]|5[0-9]|6[0-9]|7|8[0-9]|9[0-9])",
    "local": r"555",
    "natid": r"^(?!000|666|9)",
    "name": r"(?:Anna|Maria|John|James|Mary|Peter|Paul|Laura|David|Sarah|Hans|Klaus|Marie|Pierre|Carlos|Ana)\b",
    "iban": r"^(?:DE|FR|ES|GB|IT|NL|BE|AT|CH|PL|PT|SE|DK|FI|NO|IE|LU)",
    "secret": r"^(?:AKIA|ASIA|AIza|ghp_|gho_|glpat-|xox[abp]-|sk-|eyJ)",
}
CONTEXT, SPAN_BLOCK = 32, 256
EM_ROUNDS, STEPS, RATE, ACCEPT = 30, 300, 0.5, 0.5


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def valid(kind: str, match: Column) -> Column:
    """Whether a match passes its kind's own test."""
    n = F.length(digits(match))
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return n.between(13, 19) & F.coalesce(F.call_function("luhn_check", F.when(n.between(13, 19), digits(match)).otherwise("0")), F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        # mod 97 of the number that the letters and digits make with the first four at the end
        own = F.upper(F.regexp_replace(match, "[^A-Za-z0-9]", ""))
        code = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        turned = F.concat(F.substring(own, 5, 64), F.substring(own, 1, 4))
        return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(code(c) > 9, 100).otherwise(10) + code(c)) % 97)) == 1
    if kind == "secret":
        return match.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(F.left(match, F.lit(128)), ""))) >= 8)
    if kind == "natid":
        return match.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")
    return F.lit(True)


def well_formed(kind: str, match: Column) -> Column:
    """What the form labeler asks: the kind's own test, and of a secret to be hexadecimal, capitals and digits, or
    all three of capitals, small letters and digits, without separators."""
    if kind == "secret":
        three = match.rlike("[a-z]") & match.rlike("[A-Z]") & match.rlike("^[A-Za-z0-9]{20,}=*$")
        return valid(kind, match) & (match.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") | match.rlike("^[A-Z0-9]+$") | three)
    return valid(kind, match)


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once, however often later expressions use them: a one-row generator
    stands between, through which projections aren't merged."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _scan(text: Column, kind: str) -> tuple[Column, Column]:
    """The matches of a kind, and the texts between them (one more than matches)."""
    none = F.array().cast("array<string>")
    may = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else F.lit(True)
    if kind not in ("email", "name"):
        may = may & text.rlike("[0-9]")
    pattern = PATTERNS[kind]
    return F.when(may, F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(none), F.when(may, F.split(text, pattern, -1)).otherwise(none)


def _starts(widths: Column, gaps: Column) -> Column:
    """Where matches start, from the lengths of gap + match pairs and of the gaps: running sums in blocks of
    SPAN_BLOCK, so that texts of very many matches cost no square."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)
    n = F.size(widths)
    block = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / SPAN_BLOCK).cast("int")), lambda b: F.slice(widths, b * SPAN_BLOCK + 1, SPAN_BLOCK))
    sums = F.transform(block, total)
    each = F.transform(block, lambda own, b: F.transform(own, lambda _, i: total(F.slice(sums, F.lit(1), b)) + total(F.slice(own, F.lit(1), i)) + F.element_at(gaps, (b * SPAN_BLOCK + i + 1).cast("int"))))
    return F.when(n > 0, F.flatten(each)).otherwise(F.array().cast("array<bigint>"))


def _widths(matches: Column, gaps: Column) -> Column:
    return F.transform(matches, lambda x, i: (F.length(x) + F.length(F.element_at(gaps, i + 1))).cast("long"))


def candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """df with found: an array of (kind, start, end, match, before), in the order of KINDS, then of start."""
    names = {}
    for kind in KINDS:
        m, g = _scan(F.col(text), kind)
        names |= {f"__m_{kind}": m, f"__g_{kind}": g}
    df = _held(df, **names)
    lengths = {}
    for kind in KINDS:
        m, g = F.col(f"__m_{kind}"), F.col(f"__g_{kind}")
        lengths[f"__l_{kind}"] = F.transform(g, lambda x: F.length(x).cast("long"))
        lengths[f"__w_{kind}"] = _widths(m, g)
    df = _held(df, **lengths)
    df = _held(df, **{f"__s_{k}": _starts(F.col(f"__w_{k}"), F.col(f"__l_{k}")) for k in KINDS})

    def rows(kind: str) -> Column:
        m, g, s = (F.col(f"__{x}_{kind}") for x in "mgs")
        return F.transform(m, lambda x, i: F.struct(F.lit(kind).alias("kind"), F.element_at(s, i + 1).alias("start"), (F.element_at(s, i + 1) + F.length(x)).alias("end"), x.alias("match"), F.lower(F.right(F.element_at(g, i + 1), F.lit(CONTEXT))).alias("before")))

    df = _held(df, found=F.concat(*[rows(k) for k in KINDS]))
    return df.drop(*[f"__{x}_{k}" for k in KINDS for x in "mglws"])


def votes(c: Column) -> dict[str, Column]:
    """Each labeler's vote on a candidate: 1 for personal data, -1 against, 0 none."""
    of = lambda table, x: F.coalesce(*[F.when(c["kind"] == k, x.rlike(p)) for k, p in table.items()], F.lit(False))
    own = F.coalesce(*[F.when(c["kind"] == k, well_formed(k, c["match"])) for k in KINDS], F.lit(False))
    n = F.length(digits(c["match"]))
    return {
        "form": F.when(own, 1).otherwise(-1),
        "known": F.when(of(GAZETTEER, c["match"]), 1).otherwise(0),
        "cue": F.when(of(CUES, c["before"]), 1).otherwise(0),
        "against": F.when(c["before"].rlike(AGAINST), -1).otherwise(0),
        "plain": F.when((n > 0) & (F.length(F.regexp_replace(digits(c["match"]), "(.)\\1+", "$1")) <= 2), -1).otherwise(0),
    }


VOTERS = ("form", "known", "cue", "against", "plain")


def shapes(c: Column) -> dict[str, Column]:
    """What the classifier sees besides votes: which characters a candidate has, and about how long it is."""
    m = c["match"]
    mix = F.when(~m.rlike("[A-Za-z]"), "digits").when(m.rlike("^[0-9a-fA-F]+$"), "hex").when(m.rlike("[0-9]"), "mixed").otherwise("letters")
    return {"mix": mix, "length": F.when(F.length(m) < 12, "short").when(F.length(m) < 24, "middle").otherwise("long")}


SHAPES = ("mix", "length")


@dataclass(frozen=True)
class Model:
    """Logistic weights: a bias, and one of each (feature, value): kinds, votes and shapes."""

    bias: float
    weight: dict[tuple[str, str | int], float]

    def accepts(self, c: Column) -> Column:
        z = F.lit(self.bias)
        for name, v in {"kind": c["kind"], **votes(c), **shapes(c)}.items():
            z = z + F.coalesce(*[F.when(v == value, F.lit(w)) for (n, value), w in self.weight.items() if n == name], F.lit(0.0))
        return 1 / (1 + F.exp(-z)) >= ACCEPT


def reliabilities(table: list[tuple[tuple, float]]) -> tuple[float, dict[tuple[int, int], tuple[float, float]], list[float]]:
    """Expectation-maximisation over (votes, count) of a two-class model whose voters are independent given the
    class: the share of the class 1, P(vote | 1) and P(vote | 0) of each (voter, vote), and each row's posterior."""
    post = [min(0.95, max(0.05, 0.5 + 0.2 * sum(v))) for v, _ in table]
    share, given = 0.5, {}
    for _ in range(EM_ROUNDS):
        total = sum(n for _, n in table)
        ones = sum(p * n for p, (_, n) in zip(post, table))
        share = min(0.999, max(0.001, ones / total))
        sums: dict[tuple[int, int], list[float]] = {}
        for p, (v, n) in zip(post, table):
            for voter, vote in enumerate(v):
                s = sums.setdefault((voter, vote), [1.0, 1.0])
                s[0] += p * n
                s[1] += (1 - p) * n
        # the form labeler is better than chance by design, which keeps the classes from changing places
        given = {k: (a / (ones + 3), b / (total - ones + 3)) for k, (a, b) in sums.items()}
        post = []
        for v, _ in table:
            odds = math.log(share / (1 - share)) + sum(math.log(given[i, x][0] / given[i, x][1]) for i, x in enumerate(v))
            post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    return share, given, post


def train(found: DataFrame) -> Model:
    """found: rows with an array of candidates. What leaves the cluster is one count a kind, vote pattern and
    shape, at most len(KINDS) * 2 ** 5 * 4 * 3 rows."""
    each = found.select(F.explode("found").alias("c"))
    columns = {"kind": F.col("c.kind"), **votes(F.col("c")), **shapes(F.col("c"))}
    patterns = each.select(*[v.alias(n) for n, v in columns.items()]).groupBy(*columns).agg(F.count("*").alias("n")).collect()
    patterns = sorted((tuple(r[n] for n in columns), float(r["n"])) for r in patterns)
    if not patterns:
        return Model(-1.0, {})
    tallies: dict[tuple, float] = {}
    for values, n in patterns:
        own = values[1 : 1 + len(VOTERS)]
        tallies[own] = tallies.get(own, 0.0) + n
    post = dict(zip(tallies, reliabilities(list(tallies.items()))[2]))
    # rows weigh the logarithm of their count, so no kind drowns the others
    rows = [(list(zip(columns, values)), post[values[1 : 1 + len(VOTERS)]], math.log1p(n)) for values, n in patterns]
    weight, bias = dict.fromkeys(sorted({f for own, _, _ in rows for f in own}, key=str), 0.0), 0.0
    size = sum(n for _, _, n in rows)
    for _ in range(STEPS):
        grad, slope = dict.fromkeys(weight, 0.0), 0.0
        for own, p, n in rows:
            z = bias + sum(weight[f] for f in own)
            g = n / size * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p)
            slope += g
            for f in own:
                grad[f] += g
        bias -= RATE * slope
        for f in weight:
            weight[f] -= RATE * (grad[f] + 1e-3 * weight[f])
    return Model(bias, weight)


def spans(df: DataFrame, model: Model | None = None, text: str = "text") -> DataFrame:
    """df with base and added: arrays of (kind, start, end, match, before). Start and end count code points, end
    exclusive. base has the base kinds' matches that pass; added what the classifier accepts and no base span
    overlaps."""
    found = candidates(df.withColumn(text, F.coalesce(F.col(text), F.lit(""))), text)
    model = model or train(found.select("found"))
    is_base = lambda c: c["kind"].isin(*BASE)
    passes = lambda c: F.coalesce(*[F.when(c["kind"] == k, valid(k, c["match"])) for k in BASE])
    found = _held(found, base=F.filter("found", lambda c: is_base(c) & passes(c)), extra=F.filter("found", lambda c: ~is_base(c) & model.accepts(c)))
    clear = F.filter("extra", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return _held(found, added=clear).drop("found", "extra")


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda c: F.concat_ws(":", c["kind"], c["start"], c["end"])), ",")


def find(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """docs' columns in keep (doc_id by default), n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    A null text is empty: no spans, and the SHA-256 of nothing. Every row is read by itself: repeated rows get
    equal results, and other columns are never looked at.
    """
    found = spans(docs.select(*(keep or ["doc_id"]), F.col("text").alias("__text")), text="__text")
    count = lambda kind: F.size(F.filter("base", lambda c: c["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(*(keep or ["doc_id"]), *map(count, BASE), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with what the spans of its text cover replaced by <kind>; overlapping spans are one, named after the
    first of them (of equal starts the longest). All spans are those of the original text. The classifier is
    trained on the texts as they come. A null text stays null."""
    columns = docs.columns
    own = F.struct(*[F.col(f"`{c}`") for c in columns])
    found = spans(docs.select(own.alias("__row"), F.col(text).alias("__text")), text="__text")
    ordered = F.array_sort(F.transform(F.concat("base", "added"), lambda c: F.struct(c["start"].alias("start"), (-c["end"]).alias("last"), c["kind"].alias("kind"))))
    found = _held(found, __s=F.transform(ordered, lambda c: F.struct(c["start"].alias("start"), (-c["last"]).alias("end"), c["kind"].alias("kind"))))

    def join(held: Column, c: Column) -> Column:
        last = F.element_at(held, -1)
        meets = (F.size(held) > 0) & (F.try_element_at(held, F.lit(-1))["end"] > c["start"])
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], c["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when(meets, F.concat(F.slice(held, F.lit(1), F.size(held) - 1), F.array(longer))).otherwise(F.concat(held, F.array(c)))

    none = F.array().cast("array<struct<start: bigint, end: bigint, kind: string>>")
    found = _held(found, __m=F.aggregate("__s", none, join), __c=F.when(F.size("__s") > 0, F.split(F.col("__text"), "")))

    def part(c: Column, i: Column) -> Column:
        before = F.coalesce(F.try_element_at(F.col("__m"), i)["end"], F.lit(0))
        gap = F.slice("__c", (before + 1).cast("int"), (c["start"] - before).cast("int"))
        return F.concat(F.array_join(gap, ""), F.lit("<"), c["kind"], F.lit(">"))

    end = F.element_at(F.col("__m"), -1)["end"]
    parts = F.concat(F.array_join(F.transform("__m", lambda c, i: F.when(i == 0, F.concat(F.array_join(F.slice("__c", F.lit(1), c["start"].cast("int")), ""), F.lit("<"), c["kind"], F.lit(">"))).otherwise(part(c, i))), ""), F.array_join(F.slice("__c", (end + 1).cast("int"), F.size("__c")), ""))
    new = F.when(F.size("__m") > 0, parts).otherwise(F.col("__row")[text])
    return found.select(*[(new if c == text else F.col("__row")[c]).alias(c) for c in columns])
