"""Personal data: regular expressions propose spans, checksums confirm them, context words score them.

Offsets are code points, the end exclusive. A null text counts as empty and has no spans; rows
that repeat are judged one by one; an empty table gives no rows. Only the columns named are read.
All of it is built-in functions on one row at a time: no shuffle, no Python. Very long texts are read
whole: a text is cut at its matches once, and what is asked of a match is asked of the parts beside it,
so the time of a text with n matches grows by n * sqrt(n).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands around each match while the text is split; a text's own are replaced, one for one.
MARK, SPARE = "\u0001", "\u0002"
SPAN = "array<struct<kind:string,start:int,end:int,text:string,near:string>>"
#: No match is shorter, so that many characters have no more parts than twice a fifth of them.
SHORTEST = 5


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    ``pattern`` is written with possessive repeats, which match what greedy ones match here, as no
    character that may follow a repeat is in it; Java walks them without recursion. Look-behinds
    keep a failing run from being tried again from each of its characters. Of an iban the pattern is
    only the beginning: what follows an account number may look like more of it, so all ends are
    tried (``_accounts``).
    """

    name: str
    needs: str  # a text without a match of this has no span
    pattern: str
    score: float
    words: str  # context words, lower case, as a regular expression
    gain: float = 0.1
    least: float = 0.0  # spans that score less are dropped


#: The kinds, in the order of the results. The first four are the base.
KINDS = (
    Kind("email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, "mail|contact|write"),
    Kind("ip", ".", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", 0.6, "ip|host|server|address|login"),
    Kind("card", "", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){15,18}+(?![ -]?[0-9])", 0.8, "card|credit|visa|pay|amex"),
    Kind("phone", "+", r"\+[0-9][ ().0-9-]+[0-9]", 0.7, "phone|tel|call|mobile|fax"),
    Kind("iban", "", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?: ?[A-Z0-9]){11})", 0.8, "iban|bank|account|konto|compte"),
    Kind("ssn", "-", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, "ssn|social security|tax id", 0.5, 0.5),
)
BASE = ("email", "ip", "card", "phone")
#: How many characters account numbers have, by country.
ACCOUNT_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_valid(number: Column) -> Column:
    """Whether a string of digits passes Luhn: from the right, every second digit counts double."""
    ds = F.split(F.reverse(number), "")
    total = F.aggregate(
        F.transform(ds, lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int"))),
        F.lit(0), lambda a, x: a + x,
    )
    return total % 10 == 0


def mod97_valid(account: Column) -> Column:
    """Whether an account number leaves 1 modulo 97: first four characters last, letters from 10."""
    s = F.regexp_replace(account, " ", "")
    moved = F.concat(F.substring(s, 5, F.length(s)), F.substring(s, 1, 4))
    rest = F.aggregate(
        F.split(moved, ""), F.lit(0),
        lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )
    return rest == 1


def _checked(kind: str, m: Column) -> Column:
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(bare(p)) <= 3) & (F.lpad(bare(p), 3, "0") <= "255"))
    if kind == "card":
        return luhn_valid(digits(m))
    if kind == "phone":
        return F.length(digits(m)).between(8, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(m, " ", "")).between(15, 34) & mod97_valid(m)
    return F.lit(True)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _added(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def starts(lengths: Column) -> Column:
    """The sum of the lengths before each: within runs of sqrt(n), and of the runs before."""

    def of_runs(runs: Column) -> Column:
        return let(F.transform(runs, _added), lambda sums: F.flatten(F.transform(
            runs,
            lambda run, i: let(_added(F.slice(sums, 1, i)), lambda first: F.transform(run, lambda _, j: first + _added(F.slice(run, 1, j)))),
        )))

    def of_wide(wide: Column) -> Column:
        return let(F.transform(F.sequence(F.lit(1), F.size(lengths), wide), lambda at: F.slice(lengths, at, wide)), of_runs)

    return let(F.ceil(F.sqrt(F.size(lengths))).cast("int"), of_wide)


def _matches(text: Column, kind: Kind, window: int) -> Column:
    """All matches and what is near: the marked text's parts with odd numbers."""
    empty = F.array().cast(SPAN)
    reach = 2 * -(-(68 + window) // SHORTEST) + 2

    def spans(parts: Column, at: Column) -> Column:
        def span(i: Column) -> Column:
            # The array's positions count from 1, the parts' numbers from 0.
            first = F.greatest(i - reach, F.lit(0))
            before = F.array_join(F.slice(parts, first + 1, i - first), "")
            after = F.array_join(F.slice(parts, i + 2, F.lit(reach)), "")
            left = F.substring(before, F.greatest(F.length(before) - window, F.lit(0)) + 1, F.lit(window))
            right = F.substring(after, 1, 68 + window if kind.name == "iban" else window)
            near = right if kind.name == "iban" else F.concat_ws(" ", left, right)
            own = let(parts[i], lambda p: F.struct(
                F.lit(kind.name).alias("kind"), at[i].alias("start"), (at[i] + F.length(p)).alias("end"), p.alias("text"), near.alias("near"), left.alias("left"),
            ))
            return own

        found = F.transform(F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)), span)
        if kind.name == "iban":
            return _accounts(found, window)
        return F.transform(found, lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "start", "end", "text", "near")]))

    cut = F.split(F.regexp_replace(text, f"({kind.pattern})", f"{MARK}$1{MARK}"), MARK, -1)
    wanted = F.lit(True) if not kind.needs else F.instr(text, kind.needs) > 0
    found = let(cut, lambda parts: let(starts(F.transform(parts, lambda p: F.length(p))), lambda at: spans(parts, at)))
    return F.when(wanted & text.rlike(kind.pattern), found).otherwise(empty)


def _accounts(begun: Column, window: int) -> Column:
    """The account numbers that begin where a span does, from left to right without overlaps; ``near`` is what follows the beginning.

    A number ends where no capital or digit follows and mod 97 holds: at its country's length, else as late as possible.
    """
    country = F.create_map(*[F.lit(x) for n, names in ACCOUNT_LENGTHS.items() for c in names.split() for x in (c, n)])

    def whole(s: Column) -> Column:
        def of_rest(rest: Column) -> Column:
            run = F.regexp_extract(rest, "^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}", 0)
            ends = F.filter(
                F.sequence(F.lit(15), F.greatest(F.length(run), F.lit(15))),
                lambda n: (F.substring(rest, n, F.lit(1)) != " ") & ~F.substring(rest, n + 1, F.lit(1)).rlike("[A-Z0-9]") & _checked("iban", F.substring(run, F.lit(1), n)),
            )
            usual = lambda n: F.length(F.regexp_replace(F.substring(run, F.lit(1), n), " ", "")) == country[F.substring(run, 1, 2)]
            size = F.array_max(F.transform(ends, lambda n: F.struct(F.coalesce(usual(n), F.lit(False)).alias("usual"), n.alias("n"))))["n"]
            return let(size, lambda n: F.struct(
                F.lit("iban").alias("kind"), s["start"].alias("start"), (s["start"] + n).alias("end"), F.substring(rest, F.lit(1), n).alias("text"),
                F.concat_ws(" ", s["left"], F.substring(rest, n + 1, F.lit(window))).alias("near"),
            ))

        return let(F.concat(s["text"], s["near"]), of_rest)

    def step(a: Column, s: Column) -> Column:
        return F.when(s["start"] >= a["at"], F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(s)).alias("out"))).otherwise(a)

    first = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    return F.aggregate(F.filter(F.transform(begun, whole), lambda s: s["end"].isNotNull()), first, step, lambda a: a["out"])


def _scored(kind: Kind, spans: Column) -> Column:
    def score(s: Column) -> Column:
        return F.lit(kind.score) + F.when(F.lower(s["near"]).rlike(rf"\b(?:{kind.words})\b"), F.lit(kind.gain)).otherwise(F.lit(0.0))

    kept = F.filter(spans, lambda s: _checked(kind.name, s["text"]))
    out = F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), F.round(score(s), 3).alias("score")))
    return F.filter(out, lambda s: s["score"] >= kind.least) if kind.least else out


def find_pii(
    docs: DataFrame, text_col: str = "text", id_cols: tuple[str, ...] = ("doc_id",), kinds: tuple[Kind, ...] = KINDS, window: int = 40, name: str = "entities"
) -> DataFrame:
    """``id_cols`` and ``name``: array of (kind, start, end, text, score), by kind, then start.

    For each kind the leftmost matches that don't overlap; those whose checksum or parts fail are
    dropped and not tried again, but of an iban every end is tried. A context word within ``window`` characters raises the score.
    """
    text = F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), MARK, SPARE)
    held = docs.select(*[F.col(f"`{c}`") for c in id_cols], text.alias("__pii_text"))
    raw = held.withColumns({f"__pii_{k.name}": _matches(F.col("__pii_text"), k, window) for k in kinds})
    return raw.select(
        *[F.col(f"`{c}`") for c in id_cols],
        F.concat(*[_scored(k, F.col(f"__pii_{k.name}")) for k in kinds]).alias(name),
    )


def span_list(entities: Column) -> Column:
    """kind:start:end of each entity, comma-joined."""
    return F.array_join(F.transform(entities, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, entities: Column) -> Column:
    """The text with each entity replaced by its kind in brackets; of overlapping ones the first counts."""
    order = F.array_sort(F.transform(entities, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from:int,start:int,kind:string>>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        piece = F.struct(a["at"].alias("from"), s["start"].alias("start"), s["kind"].alias("kind"))
        over = F.struct(F.greatest(a["at"], -s["end"]).alias("at"), a["out"].alias("out"))
        return F.when(s["start"] < a["at"], over).otherwise(F.struct((-s["end"]).alias("at"), F.concat(a["out"], F.array(piece)).alias("out")))

    def filled(kept: Column, chars: Column) -> Column:
        between = F.transform(kept["out"], lambda p: F.concat(F.array_join(F.slice(chars, p["from"] + 1, p["start"] - p["from"]), ""), F.lit("["), p["kind"], F.lit("]")))
        return F.concat(F.array_join(between, ""), F.array_join(F.slice(chars, kept["at"] + 1, F.size(chars)), ""))

    whole = let(F.aggregate(order, first, step), lambda kept: let(F.split(text, ""), lambda chars: filled(kept, chars)))
    return F.when(F.size(entities) == 0, text).otherwise(whole)
