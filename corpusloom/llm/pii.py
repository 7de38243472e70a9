"""Personal data (operator 10): patterns propose spans, checksums confirm them, nearby words adjust the score.

Native Spark expressions only. A pattern's spans come from split() and regexp_extract_all():
the pieces between the matches and the matches themselves, whose lengths add up to positions
in code points. Patterns are written with possessive quantifiers and lookbehinds that leave the
leftmost non-overlapping matches unchanged but keep the matcher linear on long runs.

Kinds of the base (email, ip, card, phone) always stay once their check passes. The method adds
iban (mod-97), ssn, local phone numbers, secrets (long runs of letters and digits, of many
different ones, near a word like token or key) and 13-digit cards (Luhn) where score =
prior + checksum + context reaches THRESHOLD, if they overlap no span already there.

Edge cases: a null text counts as empty; empty texts have no spans and the hash of the empty
string; repeated rows give repeated results; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import running, table

LOCAL = r"A-Za-z0-9._%+-"
#: Base kinds in their listed order, then added ones: pattern, and a cheap test that any match needs.
PATTERNS = {
    "email": (rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": (r"[0-9]++(?:[\x20-][0-9]++)*+", r"[0-9][0-9\x20-]{12}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-"),
    "local": (r"(?<![0-9+(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", r"[0-9]{3}[\x20.-][0-9]{4}"),
    "secret": (r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9_-]{28,}+|[A-Za-z0-9+/]{28,}+)={0,2}(?![A-Za-z0-9+/_-])", r"[A-Za-z0-9+/_-]{28}"),
    "oldcard": (r"(?<![0-9-])[0-9](?:[\x20-]?[0-9]){12}(?![0-9-])", r"[0-9][0-9\x20-]{12}"),
}
BASE = ("email", "ip", "card", "phone")
#: Of the added kinds: prior, what a passed checksum adds, what a context word adds, context words.
SCORES = {
    "iban": (0.3, 0.5, 0.2, "iban|bank|account|konto|compte|cuenta"),
    "ssn": (0.4, 0.0, 0.4, "ssn|social security|tax id"),
    "local": (0.4, 0.0, 0.4, "phone|tel|call|mobile|fax|telefon|teléfono"),
    "secret": (0.1, 0.4, 0.3, r"token|secret|passw|key|auth|bearer|credential"),
    "oldcard": (0.1, 0.4, 0.3, "card|visa|credit|karte|carte|tarjeta"),
}
THRESHOLD, CONTEXT = 0.75, 40
BYTE = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(digits)
    digit = lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + digit(i) - F.when(digit(i) > 9, 9).otherwise(0)) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number passes ISO 7064 mod 97."""
    code = F.regexp_replace(iban, " ", "")
    code = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))
    value = lambda i: F.conv(F.substring(code, i, F.lit(1)), 36, 10).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.length(code)), F.lit(0), lambda a, i: (a * F.when(value(i) > 9, 100).otherwise(10) + value(i)) % 97) == 1


#: The check that a match has to pass; kinds not listed have none.
CHECKS = {
    "ip": lambda m: F.forall(F.split(m, r"\."), lambda p: F.regexp_like(p, F.lit(BYTE))),
    "card": lambda m: F.when(F.length(_digits(m)).between(14, 19), luhn(_digits(m))).otherwise(False),
    "phone": lambda m: F.length(_digits(m)).between(10, 15),
    "iban": mod97,
    # drawn at random: letters and digits, many of them different
    "secret": lambda m: F.regexp_like(m, F.lit("[0-9]")) & F.regexp_like(m, F.lit("[A-Za-z]")) & (F.size(F.array_distinct(F.split(m, ""))) >= 10),
    "oldcard": lambda m: luhn(_digits(m)),
}
#: Checksums whose failure only lowers the score.
SOFT = ("iban", "secret", "oldcard")
NONE = "array<struct<start:int,ord:int,end:int,kind:string>>"


def _placed(text: str, kind: str) -> str:
    """SQL of the kind's matches, array<struct<start, m>>; of scored kinds with what stands around them."""
    pattern = f"r'{PATTERNS[kind][0]}'"
    pairs = f"zip_with(split({text}, {pattern}, -1), regexp_extract_all({text}, {pattern}, 0), (gap, m) -> named_struct('gap', gap, 'm', m))"
    after = "t.at + length(x.gap) + coalesce(length(x.m), 0)"
    if kind not in SCORES:
        placed = f"zip_with(p, {running('p', '0', after, 'int')}, (x, at) -> named_struct('start', at - length(x.m), 'm', x.m))"
    else:
        state = "struct<at:int,before:string,tail:string>"
        before = f"right(concat(t.at.tail, x.gap), {CONTEXT})"
        step = f"named_struct('at', t.at.at + length(x.gap) + coalesce(length(x.m), 0), 'before', {before}, 'tail', right(concat({before}, coalesce(x.m, '')), {CONTEXT}))"
        states = running("p", "named_struct('at', 0, 'before', '', 'tail', '')", step, state)
        # five matches and gaps have more than CONTEXT characters
        behind = "concat_ws('', " + ", ".join(f"get(p, i + {k}).gap, get(p, i + {k}).m" for k in range(1, 6)) + ")"
        near = f"transform(p, (x, i) -> named_struct('m', x.m, 'behind', left({behind}, {CONTEXT})))"
        placed = f"zip_with({near}, {states}, (x, at) -> named_struct('start', at.at - length(x.m), 'm', x.m, 'around', concat(at.before, ' ', x.behind)))"
    return f"filter(get(transform(array({pairs}), p -> {placed}), 0), x -> x.m IS NOT NULL)"


def spans(text: str, kind: str) -> Column:
    """array<struct<start, ord, end, kind>> of the kind's confirmed matches in the column text; positions in code points. Time grows in proportion to the matches."""
    found = F.expr(_placed(text, kind))
    if kind in CHECKS and kind not in SOFT:
        found = F.filter(found, lambda x: CHECKS[kind](x["m"]))
    if kind in SCORES:
        prior, check, near, words = SCORES[kind]

        def enough(x: Column) -> Column:
            passed = F.when(CHECKS[kind](x["m"]), check).otherwise(-1.0) if kind in SOFT else F.lit(check)
            return F.lit(prior) + passed + F.when(F.regexp_like(F.lower(x["around"]), F.lit(words)), near).otherwise(0.0) >= THRESHOLD

        found = F.filter(found, enough)
    order = list(PATTERNS).index(kind)
    out = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("ord"), (x["start"] + F.length(x["m"])).cast("int").alias("end"), F.lit(kind).alias("kind")))
    return F.when(F.regexp_like(text, F.lit(PATTERNS[kind][1])), out).otherwise(F.array().cast(NONE))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


#: Pairs of spans that are compared one by one; of more, each is compared with its neighbours among all in order.
FEW_PAIRS = 4_096


def _apart(kind: str, ord: int, before: str) -> str:
    """SQL of the kind's spans that overlap none of those before, which are of kinds with lesser ord."""
    each = f"filter({kind}, x -> NOT exists({before}, b -> b.start < x.end AND x.start < b.end))"
    reach = running("a", "-1", f"if(x.ord = {ord}, t.at, greatest(t.at, x.end))", "int")
    follow = running("reverse(a)", str(2**31 - 1), f"if(x.ord = {ord}, t.at, x.start)", "int")
    around = f"zip_with({reach}, reverse({follow}), (f, g) -> named_struct('reach', f, 'follow', g))"
    free = f"filter(zip_with(a, {around}, (x, n) -> named_struct('x', x, 'n', n)), e -> e.x.ord = {ord} AND e.n.reach <= e.x.start AND e.n.follow >= e.x.end)"
    merged = f"get(transform(array(array_sort(concat({before}, {kind}))), a -> transform({free}, e -> e.x)), 0)"
    return f"if(cast(size({kind}) AS bigint) * size({before}) <= {FEW_PAIRS}, {each}, {merged})"


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, base and all (arrays of spans, sorted by start and kind).

    A narrow projection; texts without a digit or @ are not looked at further.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kinds = rows.select("doc_id", *[spans("text", k).alias(k) for k in PATTERNS])
    found = kinds.withColumn("base", F.array_sort(F.concat(*BASE)))
    found = found.withColumn("all", F.col("base"))
    for ord, kind in enumerate(PATTERNS):
        if kind not in BASE:
            found = found.withColumn("all", F.expr(f"if(size({kind}) = 0, `all`, concat(`all`, {_apart(kind, ord, '`all`')}))"))
    return found.select("doc_id", "base", F.array_sort("all").alias("all"))


def _of_kind(kind: str) -> Column:
    return F.filter("base", lambda s: s["kind"] == kind)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    counts = [F.size(_of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"), F.size("all").cast("long").alias("n_spans"), (F.size("all") > 0).alias("has_pii"))
