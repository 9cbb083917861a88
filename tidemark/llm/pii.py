"""Personal data by weak supervision.

Three labelers propose spans: regular expressions, a gazetteer of known beginnings, and a context labeler that takes what
follows a cue. Every labeler votes on every span for (1), against (-1) or not at all (0), whoever proposed it; so do
labelers of its strict form, its borders and its length. Expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is; the spans' posteriors then train a naive Bayes span classifier on features of the
span and its neighbours, and the classifier decides, for every kind, which spans beyond the base are added.
Base spans, which a contract fixes, always stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import passing, row_of, written

#: Order of kinds in results.
BASE = ("email", "ip", "card", "phone")
EXTRA = ("secret", "iban", "ssn", "person")
LABELERS = ("form", "regex", "gazetteer", "context", "border", "length")


@dataclass(frozen=True)
class Kind:
    """pattern proposes as the regex labeler; listed and cued, if any, as the gazetteer and the context labeler.

    hint is a cheap condition for listed or cued to match at all. strict, known and cue make the votes on a span: its form,
    its beginning or ending, and the words before it.
    """

    name: str
    pattern: str
    strict: str
    known: str
    cue: str
    lengths: tuple[int, int]
    listed: str = ""
    cued: str = ""
    hint: str = ""


#: Possessive quantifiers keep Java's matcher from recursing; a look-behind lets a run be tried once, at its start.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"^[A-Za-z0-9][A-Za-z0-9._%+-]*(@|\x20?[(\[](?i:at)[)\]]\x20?)[A-Za-z0-9.-]+(\.|\x20?[(\[](?i:dot)[)\]]\x20?| (?i:dot) )[A-Za-z]{2,}$",
         r"\.(com|org|net|edu|gov|io|de|fr|es|uk|eu)$", "mail|contact|write|correo|kontakt", (6, 64),
         listed=r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[](?i:at)[)\]]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[](?i:dot)[)\]]\x20?|\x20(?i:dot)\x20)[A-Za-z]{2,24}+)+", hint=r"[(\[](?i:at)[)\]]"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", r"^([1-9]?[0-9]|1[0-9]{2}|2[0-5]{2})(\.([1-9]?[0-9]|1[0-9]{2}|2[0-5]{2})){3}$", r"^(10|127|172|192)\.", "ip|host|server|address|addr", (7, 15)),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"^[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}$", r"^(4|5[1-5]|3[47]|6)", "card|visa|credit|karte|tarjeta|carte", (15, 19)),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"^\+?[0-9]{0,3} ?\(?[0-9]{2,4}\)?([ .-]?[0-9]{2,4}){2,4}$", r"^\+(1|33|34|44|49)\b", "phone|call|tel|mobile|fax", (10, 20),
         cued=r"(?<=(?i:phone|telephone|tel|call|mobile|fax|handy)[.:]{0,2}\x20{0,2})(?:\([0-9]{2,4}\)|[0-9]{2,5})(?:[\x20.-]?[0-9]{2,4}){2,4}+(?![0-9])", hint="(?i:phone|tel|call|mobile|fax|handy)[.:\x20]{0,4}[(0-9]"),
    Kind("secret", r"(?i:password|passwd|secret|token|api_key)\x20?[=:]\x20?\"?[A-Za-z0-9_/+-]{8,}+\"?", r"[0-9]", r"^(AKIA|ASIA|gh[pousr]_|glpat-|xox[abp]-|sk_live_|AIza|(?i:password=|token = \"))", "key|secret|login", (16, 80),
         listed=r"(?<![A-Za-z0-9_-])(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Z])|(?<![A-Za-z0-9_-])(?:gh[pousr]_|glpat-|xox[abp]-|sk_live_|AIza)[A-Za-z0-9_-]{16,}+",
         cued=r"(?<=(?i:pwd|credential|credentials|passwort|clave|access_key|private_key|auth)\x20?[=:]\x20?\"?)[A-Za-z0-9_/+-]{8,}+", hint=r"AKIA|ASIA|gh[pousr]_|glpat-|xox[abp]-|sk_live_|AIza|(?i:pwd|credential|passwort|clave|_key|auth)"),
    Kind("iban", r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+", r"^[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}[ 0-9]{7,}$", r"^(DE|FR|ES|GB|IT|NL|CH|AT|BE)", "iban|account|konto|cuenta|bank", (15, 42),
         cued=r"(?<=(?i:iban)[:\x20]{0,3})[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4}){2,7}+(?:\x20[A-Z0-9]{1,3})?(?![A-Z0-9])", hint="(?i:iban)"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"^(?!000|666|9)[0-9]{3}-?(?!00)[0-9]{2}-?(?!0000)[0-9]{4}$", r"^[0-6]", "ssn|social|security", (9, 11),
         cued=r"(?<=(?i:ssn|social security|social security number)[:#\x20]{0,3})[0-9]{9}(?![0-9])", hint="(?i:ssn|social security)"),
    Kind("person", r"(?<=(?i:my name is|signed by|mein name ist|me llamo|je m'appelle)\x20)\p{Lu}\p{Ll}{1,20}+(?:\x20\p{Lu}\p{Ll}{1,20}+){1,3}", r"^((Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Señora?)\.? )?\p{Lu}\p{Ll}+( \p{Lu}\p{Ll}+){0,3}$",
         r"^(Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Señora?)\b", "name|signed|contact|dear|appelle|llamo", (5, 80),
         listed=r"(?<!\p{L})(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Señora?)\.?\x20\p{Lu}\p{Ll}{1,20}+(?:\x20\p{Lu}\p{Ll}{1,20}+){0,2}", hint=r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Señora?)\.?\x20"),
)
REACH = 40


def _may(kind: str, t: Column) -> Column:
    """A cheap necessary condition for a kind to occur at all."""
    has = lambda *xs: [F.contains(t, F.lit(x)) for x in xs]
    if kind == "email":
        return has("@")[0]
    if kind == "phone":
        return has("+")[0]
    if kind == "ip":
        return t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]")
    if kind == "card":
        return t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}")
    if kind == "ssn":
        return has("-")[0] & t.rlike("[0-9]-[0-9]{2}-[0-9]")
    if kind == "secret":
        return t.rlike("(?i:password|passwd|secret|token|api_key)")
    if kind == "person":
        return t.rlike("(?i:name is|signed by|name ist|me llamo|je m'appelle)")
    return t.rlike("[A-Z]{2}[0-9]{2}[A-Z0-9]{11}")


def _spans(pattern: str, t: Column) -> Column:
    """Leftmost non-overlapping matches with start and end in code points: what stands between them gives the places."""
    found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    gaps = F.split(t, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,v:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["g"])
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("v")))).alias("out"))

    both = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    return F.aggregate(both, start, step, lambda acc: acc["out"])


def luhn(digits: Column) -> Column:
    """Digit sum, every second digit from the right doubled, divisible by 10."""
    d = F.reverse(F.split(digits, ""))
    d = F.filter(d, lambda x: x != "")
    value = F.transform(d, lambda x, i: F.when(i % 2 == 1, x.cast("int") * 2).otherwise(x.cast("int")))
    return F.aggregate(value, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    """Whether a match of a base kind counts as base."""
    digits = F.regexp_replace(v, "[^0-9]", "")
    if kind == "ip":
        part = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, p.substr(-3, 3).cast("int")), F.lit(999)) <= 255)
        return F.forall(F.split(v, r"\."), part)
    if kind == "card":
        return F.length(digits).between(14, 19) & F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(kind in BASE)


_SPANS, _CANDIDATES = "array<struct<s:int,e:int,v:string>>", "array<struct<order:int,kind:string,start:int,end:int,base:boolean,votes:string,features:array<string>>>"


def _proposed(kind: Kind, t: Column) -> Column:
    """Spans of the regex labeler, and of the others those that don't overlap one: array of (span, whether by regex)."""
    none = F.array().cast(_SPANS)
    mine = F.when(_may(kind.name, t), _spans(kind.pattern, t)).otherwise(none)
    by = lambda spans, regex: F.transform(spans, lambda x: F.struct(x.alias("x"), F.lit(regex).alias("regex")))
    more = "|".join(x for x in (kind.listed, kind.cued) if x)
    if not more:
        return by(mine, True)
    theirs = F.when(t.rlike(kind.hint), _spans(more, t)).otherwise(none)
    free = F.filter(theirs, lambda x: ~F.exists(mine, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])))
    return F.concat(by(mine, True), by(free, False))


def _described(kind: Kind, order: int, t: Column) -> Column:
    """Candidates of a kind: place, whether base, one vote per labeler, features of the classifier."""

    def vote(yes: Column, no: Column) -> Column:
        return F.when(yes, "+").when(no, "-").otherwise("0")

    def one(p: Column) -> Column:
        x = p["x"]
        v = x["v"]
        before = F.substring(t, F.greatest(F.lit(1), x["s"] - (REACH - 1)), F.least(x["s"], F.lit(REACH)))
        left, right = F.right(before, F.lit(1)), F.substring(t, x["e"] + 1, F.lit(1))
        base = p["regex"] & _valid(kind.name, v)
        strict, known = v.rlike(kind.strict) & (base if kind.name in BASE else F.lit(True) | base), v.rlike(kind.known)
        near = F.lower(before).rlike(kind.cue)
        loose = ~left.rlike(r"[\p{L}\p{N}]") & ~right.rlike(r"[\p{L}\p{N}]")
        long = F.length(v).between(*kind.lengths)
        digits = F.length(F.regexp_replace(v, "[^0-9]", "")) * 4 / F.length(v)
        votes = F.concat(vote(strict, ~strict), vote(p["regex"], F.lit(False)), vote(known, F.lit(False)), vote(near, F.lit(False)), vote(loose, ~loose), vote(long, ~long))
        side = lambda c: F.when(c == "", "edge").when(c.rlike(r"\s"), "space").when(c.rlike(r"[\p{L}\p{N}]"), "word").otherwise("mark")
        features = F.array(
            F.lit("kind=" + kind.name), F.concat(F.lit(kind.name + ":len="), F.least(F.lit(24), (F.length(v) / 4).cast("int")).cast("string")), F.concat(F.lit(kind.name + ":form="), vote(strict, ~strict)),
            F.concat(F.lit(kind.name + ":digits="), digits.cast("int").cast("string")), F.concat(F.lit("left="), side(left)), F.concat(F.lit("right="), side(right)),
        )
        return F.struct(
            F.lit(order).alias("order"), F.lit(kind.name).alias("kind"), x["s"].alias("start"), x["e"].alias("end"), base.alias("base"), votes.alias("votes"), features.alias("features")
        )

    return F.transform(_proposed(kind, t), one)


#: Features of a candidate; values are kinds, marks and capped numbers, so there is a bounded number of them.
FEATURES = 6


def candidates(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """r (the columns in keep) and c: every proposed span; matches that fail a base test are proposals, not base spans."""
    rows = docs.select(row_of(keep), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.select("r", F.concat(*[_described(k, i, F.col("t")).cast(_CANDIDATES) for i, k in enumerate(KINDS)]).alias("c"))


def fit_labelers(patterns: Iterable[tuple[str, int]], rounds: int = 30) -> tuple[dict[str, float], list[dict[str, tuple[float, float]]], float]:
    """EM over (vote pattern, count): posterior of each pattern, each labeler's P(vote | truth) for false and true, prior.

    There are at most 3 to the number of labelers patterns, however large the corpus.
    """
    counts = [(p, n) for p, n in patterns if n > 0]
    post = {p: min(0.95, max(0.05, 0.5 + 0.15 * (p.count("+") - 2 * p.count("-")))) for p, _ in counts}
    tables: list[dict[str, tuple[float, float]]] = []
    prior = 0.5
    for _ in range(rounds):
        yes = sum(n * post[p] for p, n in counts)
        total = sum(n for _, n in counts)
        prior = (yes + 1) / (total + 2)
        tables = []
        for k in range(len(LABELERS)):
            row = {}
            for v in "+-0":
                a = sum(n * (1 - post[p]) for p, n in counts if p[k] == v)
                b = sum(n * post[p] for p, n in counts if p[k] == v)
                row[v] = ((a + 1) / (total - yes + 3), (b + 1) / (yes + 3))
            tables.append(row)
        for p, _ in counts:
            odds = math.log(prior / (1 - prior)) + sum(math.log(t[v][1] / t[v][0]) for t, v in zip(tables, p))
            post[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post, tables, prior


def find_pii(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, sure: float = 0.9) -> DataFrame:
    """docs (or its columns in keep) with _p: spans (start, order, kind, end, base), by start and then kind.

    Texts are scanned once; null and empty texts have no spans. Spans of different kinds may overlap, those of one kind
    don't. Repeated rows get equal results; a corpus without candidates needs no model. A column _p of docs, in whatever
    case, is replaced. What the models are fitted from are counts over all candidates of the corpus, at most one row per
    vote pattern and per feature value.
    """
    keep = passing(docs.columns if keep is None else keep, ["_p"])
    found = written(candidates(docs, text_col, keep), "spans")
    spans = found.select(F.explode("c").alias("c"))
    post, _, _ = fit_labelers([(r[0], r[1]) for r in spans.groupBy("c.votes").count().collect()])
    if post:
        believed = F.element_at(F.create_map(*[F.lit(x) for kv in sorted(post.items()) for x in kv]), F.col("c.votes"))
        sums = spans.select(believed.alias("p"), F.explode("c.features").alias("f")).groupBy("f").agg(F.sum(F.lit(1) - F.col("p")), F.sum("p")).collect()
        weigh, start = fit_classifier(sorted((r[0], r[1], r[2]) for r in sums))
        weights = F.create_map(*[F.lit(x) for kv in sorted(weigh.items()) for x in kv])
        score = lambda c: F.aggregate(c["features"], F.lit(start), lambda a, f: a + F.coalesce(F.element_at(weights, f), F.lit(0.0)))
        taken = F.filter("c", lambda c: c["base"] | (score(c) >= math.log(sure / (1 - sure))))
    else:
        taken = F.col("c")
    plain = F.transform(taken, lambda c: F.struct(*[c[x].alias(x) for x in ("start", "order", "kind", "end", "base")]))
    return found.select("r.*", F.array_sort(plain).alias("_p"))


def fit_classifier(sums: list[tuple[str, float, float]]) -> tuple[dict[str, float], float]:
    """Naive Bayes from (feature value, belief against, belief for): log ratio of every value, and of the classes.

    A weight is rounded, so that the order in which beliefs were added up doesn't show.
    """
    no, yes = sum(r[1] for r in sums) / FEATURES + 1, sum(r[2] for r in sums) / FEATURES + 1
    return {f: round(math.log((b + 1) / (yes + 1)) - math.log((a + 1) / (no + 1)), 6) for f, a, b in sums}, round(math.log(yes / no), 6)


def pii_digest(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans (all of them), flagged (whether there is one).

    A null or empty text has no span: counts are 0 and base_sha256 is that of no bytes. Long texts are scanned whole, repeated
    rows get equal results, an empty table gives none, and other columns play no part.
    """
    found = find_pii(docs, text_col, keep=list(keep))
    base = F.filter("_p", lambda p: p["base"])
    shown = lambda a: F.array_join(F.transform(a, lambda p: F.concat_ws(":", p["kind"], p["start"].cast("string"), p["end"].cast("string"))), ",")
    of = lambda k: F.size(F.filter(base, lambda p: p["kind"] == k)).cast("long").alias(f"n_{k}")
    n = F.size("_p").cast("long")
    return found.select(*keep, *[of(k) for k in BASE], F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("_p")).alias("spans"), n.alias("n_spans"), (n > 0).alias("flagged"))
