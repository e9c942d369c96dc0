"""Personal data by weak supervision, with DataFrame functions only (operator 2).

1. *Candidates*: one scan finds the candidate spans of each kind, more of them than the gazetteers know: names also by
   the title before them, secrets by their alphabet and length alone, telephone numbers without a country code by their
   groups of digits. A pattern's matches are set between marks, the text is split at the marks, and lengths give the
   places; nothing but the spans leaves the scan.
2. *Votes*: on each candidate, labelers vote for, against or not at all: a strict pattern, a gazetteer, words before,
   words after, and company (other kinds' tell-tale characters close by). Votes and a length class make a *pattern*, of
   which there are at most ``PATTERNS`` a kind.
3. *Expectation maximisation*: counts of the patterns over all documents (a bounded table) give, for each kind on its
   own, its prior and each labeler's reliabilities. The posteriors train a logistic span classifier of each kind on the
   same bounded table.
4. *Decision*: the classifier's verdict on a pattern decides on the spans of the added kinds. Names and telephone
   numbers must also have a vote for them from the gazetteer or the words before. Spans of the base kinds that pass
   their checks always stay.

Patterns are linear in the text: quantifiers are possessive and matches can only start where the run of their first
characters starts. Rows never meet, so nothing can be skewed; only (kind, pattern) counts are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.storage import materialize

MARK, PLAIN = "", ""
#: Kinds in their order. The first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "secret", "name", "tel")
BASE = 4
#: Added kinds that need a vote for them from one of these labelers.
_KNOWN_BY = {"name": ("gazetteer", "before"), "tel": ("gazetteer", "before")}
#: What a text must contain for a kind to be looked for at all.
_NEEDS = {"email": "@", "phone": "+", "ip": "."}
_FIND = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    # whole runs of 14 to 19 digits; runs of other lengths match as a whole too, and fail
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+",
    "tel": r"(?<![0-9A-Za-z+(.-])(?<!\+[0-9]{1,3}[\x20.-]?)(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9A-Za-z]|[-.\x20][0-9])",
}
# Public, common values; fixed.
TOP_LEVEL = ("com", "org", "net", "edu", "gov", "io", "info", "biz", "de", "fr", "es", "uk", "eu", "us", "ca", "it", "nl", "ch", "at")
GIVEN_NAMES = (
    "James", "Mary", "John", "Patricia", "Robert", "Jennifer", "Michael", "Linda", "William", "Elizabeth", "David", "Barbara",
    "Richard", "Susan", "Joseph", "Jessica", "Thomas", "Sarah", "Charles", "Karen", "Maria", "Anna", "Peter", "Paul", "Hans",
    "Marie", "Pierre", "Jean", "Juan", "Carlos", "Ana", "Luis", "Klaus", "Ursula", "Sophie", "Lucas", "Emma", "Laura", "Daniel",
)
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Señor", "Señora", "Mme", "Monsieur")
_FIND["name"] = (
    r"(?<!\p{L})(?=\p{Lu})(?:(?:" + "|".join(GIVEN_NAMES) + r")(?:\x20\p{Lu}\p{Ll}++){1,2}+"
    r"|(?<=\b(?:" + "|".join(TITLES) + r")\.?\x20)\p{Lu}\p{Ll}++(?:\x20\p{Lu}\p{Ll}++){0,2}+)(?!\p{L})"
)
#: Area codes of public toll-free numbers.
TOLL_FREE = ("800", "833", "844", "855", "866", "877", "888")
_BEFORE = {
    "email": r"(?:e-?mail|contact|write|mailto|correo|courriel)[^a-z]{0,8}$",
    "ip": r"(?:\bip|host|server|address|adresse|client|from)[^a-z]{0,8}$",
    "card": r"(?:card|visa|credit|carte|karte|tarjeta|payment)[^a-z]{0,12}$",
    "phone": r"(?:phone|tel|call|mobile|fax|telefon|móvil)[^a-z]{0,8}$",
    "secret": r"(?:token|key|secret|password|passwd|api|auth)[^a-z]{0,8}$",
    "name": r"\b(?:mr|mrs|ms|dr|prof|herr|frau|señor|señora|mme|monsieur|name is|signed|by)\.?[^a-z]{0,3}$",
    "tel": r"(?:phone|tel|call|mobile|cell|fax|telefon|móvil)[^a-z]{0,8}$",
}
_NOT_BEFORE = r"(?:version|isbn|order|release|build|chapter|page|figure)[^a-z]{0,8}$"
_NOT_AFTER = r"^\s{0,3}(?:%|kg|km|cm|mm|eur|usd|pages|items)"
LABELERS = ("pattern", "gazetteer", "before", "after", "company")
PATTERNS = 3 ** len(LABELERS) * 4


def _luhn(digits: Column) -> Column:
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda total, i: total + _doubled(F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)),
    )
    return total % 10 == 0


def _doubled(digit: Column) -> Column:
    return F.when(digit > 9, digit - 9).otherwise(digit)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _valid(kind: str, match: Column) -> Column:
    """The base kinds' checks. Added kinds have none."""
    if kind == "ip":
        part = lambda x: F.length(F.regexp_replace(x, "^0+", "")) <= 3  # noqa: E731  a longer one can't be cast
        small = lambda x: F.coalesce(F.regexp_replace(x, "^0+(?=.)", "").try_cast("int"), F.lit(256)) <= 255
        return F.forall(F.split(match, r"\."), lambda x: part(x) & small(x))
    if kind == "card":
        return _luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(kind == "email")


def _votes(kind: str, x: Column, before: Column, after: Column) -> list[Column]:
    """-1, 0 or 1 from each labeler, in the order of ``LABELERS``."""
    yes = lambda c: F.when(c, 1).otherwise(0)
    either = lambda c: F.when(c, 1).otherwise(-1)
    digits = _digits(x)
    strict, known = {
        "email": (x.rlike(r"^[A-Za-z0-9][^@]*+@[A-Za-z0-9][A-Za-z0-9.-]*+$"), F.element_at(F.split(F.lower(x), r"\."), -1).isin(*TOP_LEVEL)),
        "ip": (x.rlike(r"^[1-9][0-9]{0,2}(?:\.(?:0|[1-9][0-9]{0,2})){3}$"), x.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\.")),
        "card": (F.length(digits).isin(15, 16), digits.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))")),
        "phone": (F.length(digits).between(10, 13), digits.rlike(r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])")),
        "secret": (x.rlike("[0-9]") & x.rlike("[A-Za-z]") & (F.length(digits) >= 3), x.rlike(r"^(?:AKIA|ASIA|ghp_|gho_|sk-|xox[bp]-)|^[0-9a-f]{32,}+$")),
        "name": (F.length(x).between(4, 40), F.split(x, " ")[0].isin(*GIVEN_NAMES)),
        "tel": (digits.rlike("^[2-9][0-9]{2}[2-9]"), F.startswith(x, F.lit("(")) | F.substring(digits, 1, 3).isin(*TOLL_FREE)),
    }[kind]
    around = F.concat(before, F.lit(" "), after)
    against = before.rlike(_NOT_BEFORE) | after.rlike(_NOT_AFTER)
    return [
        either(strict),
        yes(known),
        yes(before.rlike(_BEFORE[kind])),
        F.when(against, -1).otherwise(0),
        yes(around.rlike(r"@|\+[0-9]|[0-9]{4}")),
    ]


def _pattern(kind: str, x: Column, before: Column, after: Column) -> Column:
    code = F.lit(0)
    for vote in _votes(kind, x, before, after):
        code = code * 3 + (vote + 1)
    length = F.length(x)
    return code * 4 + F.when(length < 12, 0).when(length < 18, 1).when(length < 30, 2).otherwise(3)


def _parts(text: Column, kind: str) -> Column:
    """The text cut around a kind's matches: even places hold what is between, odd places matches. Null: no match."""
    marked = F.regexp_replace(text, _FIND[kind], f"{MARK}$0{MARK}")
    if kind in _NEEDS:
        marked = F.when(F.contains(text, F.lit(_NEEDS[kind])), marked)
    return F.when(F.contains(marked, F.lit(MARK)), F.split(marked, MARK, -1))


def _before(parts: Column, i: Column) -> Column:
    return F.lower(F.right(F.element_at(parts, i), F.lit(40)))


def _after(parts: Column, i: Column) -> Column:
    return F.lower(F.left(F.element_at(parts, i + 2), F.lit(24)))


def _spans(kind: str, parts: Column, slice_: int = 256) -> Column:
    """array<struct<s, kind, e, base, pattern>> of a kind's candidates. Places are running sums of lengths; they are
    taken over slices of the parts, so the work on many matches stays well below the square of their number."""
    number = KINDS.index(kind)
    empty = F.expr("cast(array() as array<struct<s:int,kind:int,e:int,base:boolean,pattern:int>>)")

    def step(state: Column, i: Column) -> Column:  # i: place of a part from 0
        x = F.element_at(parts, i + 1)
        end = state["at"] + F.length(x)
        valid = _valid(kind, x)
        span = F.struct(
            state["at"].alias("s"),
            F.lit(number).alias("kind"),
            end.alias("e"),
            valid.alias("base"),
            _pattern(kind, x, _before(parts, i), _after(parts, i)).cast("int").alias("pattern"),
        )
        keep = (i % 2 == 1) & (valid if number < BASE else F.lit(True))
        return F.struct(end.alias("at"), F.when(keep, F.concat(state["found"], F.array(span))).otherwise(state["found"]).alias("found"))

    def over_slice(state: Column, k: Column) -> Column:
        first = k * slice_
        own = F.aggregate(F.sequence(first, F.least(first + slice_, F.size(parts)) - 1), F.struct(state["at"].alias("at"), empty.alias("found")), step)
        # the inner state is taken apart once
        return F.aggregate(
            F.array(own), F.struct(state["at"].alias("at"), state["all"].alias("all")), lambda s, o: F.struct(o["at"].alias("at"), F.concat(s["all"], F.array(o["found"])).alias("all"))
        )

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<array<struct<s:int,kind:int,e:int,base:boolean,pattern:int>>>)").alias("all"))
    found = F.aggregate(F.sequence(F.lit(0), ((F.size(parts) - 1) / slice_).cast("int")), start, over_slice, lambda s: F.flatten(s["all"]))
    return F.when(parts.isNull(), empty).otherwise(found)


def _unmarked(text: str) -> Column:
    plain = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return F.when(F.contains(plain, F.lit(MARK)), F.translate(plain, MARK, PLAIN)).otherwise(plain)


def _with_candidates(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """``docs`` with its candidates by start, then kind, as the column ``name``."""
    safe = docs.withColumn("_safe", _unmarked(text_col))
    cut = safe.withColumns({f"_{kind}": _parts(F.col("_safe"), kind) for kind in KINDS})
    spans = F.array_sort(F.concat(*(_spans(kind, F.col(f"_{kind}")) for kind in KINDS)))
    return cut.withColumn(name, spans).drop("_safe", *(f"_{kind}" for kind in KINDS))


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``spans`` (candidates by start, then kind) in place of the text."""
    return _with_candidates(docs, text_col, "spans").drop(text_col)


@dataclass(frozen=True)
class Verdicts:
    """Probability of each (kind, pattern) that was seen, and each kind's prior and labelers' reliabilities."""

    probability: dict[tuple[int, int], float]
    reliability: dict[str, dict[str, dict[str, float]]]
    prior: dict[str, float] | None = None
    threshold: float = 0.5

    def accepts(self, kind: int, pattern: Column) -> Column:
        """Of an added kind: whether its spans with this pattern are personal data."""
        taken = [p for (k, p), probability in sorted(self.probability.items()) if k == kind and probability >= self.threshold]
        return pattern.isin(*taken) if taken else F.lit(False)


def _unpack(pattern: int) -> tuple[list[int], int]:
    pattern, length = divmod(pattern, 4)
    votes = []
    for _ in LABELERS:
        pattern, vote = divmod(pattern, 3)
        votes.append(vote)
    return votes[::-1], length


_Row = tuple[list[int], int, int, int]  # votes (0 against, 1 none, 2 for), length class, count, pattern
_AGAINST, _FOR = 0, 2


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(min(x, 30.0), -30.0)))


def _expectation_maximisation(rows: list[_Row], rounds: int = 60) -> tuple[list[float], float, list]:
    """(posterior of each row, prior, share[labeler][truth][vote]) of one kind: votes are independent given the truth."""
    posterior = [min(max(0.5 + 0.2 * sum(v - 1 for v in votes), 0.05), 0.95) for votes, *_ in rows]
    prior, share = 0.5, [[[1 / 3] * 3, [1 / 3] * 3] for _ in LABELERS]
    for _ in range(rounds):
        mass, true = 2.0, 1.0
        sums = [[[1.0] * 3, [1.0] * 3] for _ in LABELERS]
        for (votes, _, count, _), p in zip(rows, posterior, strict=True):
            mass += count
            true += count * p
            for table, vote in zip(sums, votes, strict=True):
                table[1][vote] += count * p
                table[0][vote] += count * (1 - p)
        prior = true / mass
        share = [[[x / sum(side) for x in side] for side in table] for table in sums]
        # what the labelers on the whole speak for is the truth, not its opposite
        if sum(table[1][_FOR] - table[1][_AGAINST] - table[0][_FOR] + table[0][_AGAINST] for table in share) < 0:
            share, prior = [table[::-1] for table in share], 1 - prior
        odds = math.log(prior / (1 - prior))
        posterior = [_sigmoid(odds + sum(math.log(table[1][vote] / table[0][vote]) for table, vote in zip(share, votes, strict=True))) for votes, *_ in rows]
    return posterior, prior, share


def _classifier(rows: list[_Row], posterior: list[float], steps: int = 300) -> list[float]:
    """Probability of each row by a logistic classifier of votes and length class, trained on the posteriors."""
    features = [[*(3 * k + vote for k, vote in enumerate(votes)), 3 * len(LABELERS) + length] for votes, length, *_ in rows]
    weights = [0.0] * (3 * len(LABELERS) + 4)
    total = float(sum(row[2] for row in rows))
    for _ in range(steps):
        slope = [1e-4 * w for w in weights]
        for own, p, row in zip(features, posterior, rows, strict=True):
            error = row[2] / total * (_sigmoid(sum(weights[i] for i in own)) - p)
            for i in own:
                slope[i] += error
        weights = [w - 2.0 * s for w, s in zip(weights, slope, strict=True)]
    return [_sigmoid(sum(weights[i] for i in own)) for own in features]


def estimate(counts: dict[tuple[int, int], int]) -> Verdicts:
    """Expectation maximisation over counts of (kind, pattern), then a logistic classifier on its posteriors, for each
    kind on its own. Plain arithmetic over a table of at most ``len(KINDS) * PATTERNS`` rows, whatever the data."""
    found, reliability, priors = {}, {}, {}
    for kind, name in enumerate(KINDS):
        rows = [(*_unpack(pattern), count, pattern) for (k, pattern), count in sorted(counts.items()) if k == kind]
        if not rows:
            continue
        posterior, priors[name], share = _expectation_maximisation(rows)
        needed = [LABELERS.index(labeler) for labeler in _KNOWN_BY.get(name, ())]
        for (votes, _, _, pattern), probability in zip(rows, _classifier(rows, posterior), strict=True):
            found[kind, pattern] = probability if not needed or any(votes[k] == _FOR for k in needed) else 0.0
        named = (("against", 0), ("none", 1), ("for", 2))
        reliability[name] = {labeler: {f"{vote}|{side}": table[y][v] for y, side in ((1, "true"), (0, "false")) for vote, v in named} for labeler, table in zip(LABELERS, share, strict=True)}
    return Verdicts(found, reliability, priors)


def learn(found: DataFrame) -> Verdicts:
    """Estimate from the candidates of all documents (a table with ``spans``)."""
    spans = found.select(F.explode("spans").alias("x"))
    counts = spans.groupBy("x.kind", "x.pattern").count().collect()  # at most len(KINDS) * PATTERNS rows
    return estimate({(r["kind"], r["pattern"]): r["count"] for r in counts})


def decided(found: DataFrame, verdicts: Verdicts, name: str = "spans") -> DataFrame:
    """``found`` with its spans (column ``name``) narrowed to base spans and accepted added ones."""

    def keep(x: Column) -> Column:
        accepted = F.lit(False)
        for kind in range(BASE, len(KINDS)):
            accepted = accepted | ((x["kind"] == kind) & verdicts.accepts(kind, x["pattern"]))
        return (x["kind"] < BASE) | accepted

    return found.withColumn(name, F.filter(name, keep))


def find(docs: DataFrame) -> DataFrame:
    """Spans of personal data of ``docs`` (doc_id, text): one row per row with doc_id and ``spans``, an array of
    struct(s, kind, e, base, pattern) by start, then kind; places are in code points, ends exclusive.

    A null or empty text has no spans; repeated rows are searched each; a null doc_id is kept; an empty table gives no
    rows; other columns are ignored. Kinds are searched each on their own, so spans of different kinds may overlap.
    """
    found = materialize(candidates(docs.select("doc_id", "text")), "pii_candidates")
    return decided(found, learn(found))


def joined(spans: Column, keep: Callable[[Column], Column]) -> Column:
    """kind:start:end of the spans kept, by commas."""
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
    return F.array_join(F.transform(F.filter(spans, keep), lambda x: F.concat_ws(":", name(x), x["s"].cast("string"), x["e"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    base = joined(F.col("spans"), lambda x: x["kind"] < BASE)
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(BASE)),
        F.sha2(base, 256).alias("base_sha256"),
        joined(F.col("spans"), lambda x: F.lit(True)).alias("spans"),
    )


def _replaced(text: Column, spans: Column, slice_: int = 256) -> Column:
    """The text with each run of overlapping spans replaced by the kind that begins it. It is cut in slices of the spans,
    and each slice's part of the text once more, so the work on many spans stays well below the square of their number."""
    cuts = F.expr("cast(array() as array<struct<a:int,b:int,kind:int>>)")
    names = F.array(*(F.lit(f"<{kind.upper()}>") for kind in KINDS))

    def step(state: Column, x: Column) -> Column:
        cut = F.array(F.struct(state["at"].alias("a"), x["s"].alias("b"), x["kind"].alias("kind")))
        own = F.when(x["s"] >= state["at"], F.concat(state["cuts"], cut)).otherwise(state["cuts"])
        return F.struct(F.greatest(state["at"], x["e"]).alias("at"), own.alias("cuts"))

    def over_slice(state: Column, k: Column) -> Column:
        own = F.aggregate(F.slice(spans, k * slice_ + 1, F.lit(slice_)), F.struct(state["at"].alias("at"), cuts.alias("cuts")), step)

        def shown(o: Column) -> Column:
            begin = state["at"]
            part = F.substring(text, begin + 1, o["at"] - begin)
            pieces = lambda p: F.transform(o["cuts"], lambda c: F.concat(F.substring(p, c["a"] - begin + 1, c["b"] - c["a"]), F.element_at(names, c["kind"] + 1)))
            return F.struct(o["at"].alias("at"), F.array_join(F.flatten(F.transform(F.array(part), pieces)), "").alias("text"))

        # the inner state, and what it shows, are taken apart once
        return F.aggregate(
            F.transform(F.array(own), shown), F.struct(state["at"].alias("at"), state["all"].alias("all")), lambda s, o: F.struct(o["at"].alias("at"), F.concat(s["all"], F.array(o["text"])).alias("all"))
        )

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("all"))
    slices = F.sequence(F.lit(0), ((F.size(spans) - 1) / slice_).cast("int"))
    return F.aggregate(slices, start, over_slice, lambda s: F.concat(F.array_join(s["all"], ""), F.substring(text, s["at"] + 1, F.length(text))))


def redact(docs: DataFrame, verdicts: Verdicts, text_col: str = "text") -> DataFrame:
    """``docs`` with the spans that :func:`decided` keeps of its text replaced by their kinds in angle brackets. All are
    found and decided in the text as it came; overlapping spans are replaced as one, by the kind that begins first. All
    other columns, and null texts, stay as they are; so do texts without spans."""
    out = decided(_with_candidates(docs, text_col, "_found"), verdicts, "_found")
    text = F.col(text_col).cast("string")
    return out.withColumn(text_col, F.when(F.size("_found") > 0, _replaced(text, F.col("_found"))).otherwise(F.col(text_col))).drop("_found")
