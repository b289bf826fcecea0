"""Personal data by weak supervision, in DataFrame functions only.

Every text is searched for raw matches of a few patterns per kind. Those that pass the checks of the four base kinds are
spans at once, and those that fail them are never spans. Matches of further patterns (local phone numbers, spelled-out mail
addresses, secrets) are open. Regex, gazetteer and context labelers vote on every match (+1, 0 or -1).
Expectation-maximisation over the counts of vote patterns, which Spark gathers from all documents, estimates how reliable
each labeler is for each kind, with the decided matches held at what they are, and a logistic span classifier over votes and
shape is trained on the resulting posteriors. It becomes a column expression of its weights and decides the open matches.
What the driver gets is a histogram with at most one row per kind, vote pattern and shape, whatever the input.

Defined results: a null text is empty and has no spans; positions are code points, ends exclusive; rows are judged one by
one, so null or repeated ids and repeated rows change nothing; without candidates nothing is added; an empty table gives an
empty one; other columns pass through and those named like added ones are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions.columns import block_window, let, once, text_blocks

KINDS = ["email", "ip", "card", "phone", "secret"]
EMAIL, IP, CARD, PHONE, SECRET = range(5)
LABELERS = ["regex", "gazetteer", "context", "isolation", "variety"]
THRESHOLD = 0.9
AROUND = 24

# Possessive forms of the base patterns: they match the same strings and scan a long run once. An address may also begin
# where the last one ended (\G), in the middle of a run.
PATTERNS = {
    EMAIL: "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    IP: "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    CARD: "[0-9](?:[\\x20-]?[0-9])++",
    PHONE: "\\+[0-9][\\x20().0-9-]+[0-9]",
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"

# Further candidates, which are spans only if the classifier says so.
LOCAL_PHONE = "(?<![0-9A-Za-z+])\\(?[0-9]{3}\\)?[\\x20.-][0-9]{3}[\\x20.-][0-9]{4}(?![0-9A-Za-z])"
SPELLED_MAIL = "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\\x20?[\\[(]at[\\])]\\x20?[A-Za-z0-9-]++(?:\\x20?(?:\\.|[\\[(]dot[\\])])\\x20?[A-Za-z0-9-]++)++"
LONG_TOKEN = "(?<![A-Za-z0-9_])[A-Za-z0-9_]{24,}+"

# Gazetteers and context words.
DOMAINS = ["com", "org", "net", "edu", "gov", "info", "io", "eu", "de", "fr", "es", "uk", "at", "ch", "it"]
CALLING_CODES = "^\\+(?:1|33|34|39|41|43|44|49)"
SECRET_NAMES = "(?:token|secret|password|passwd|api_?key|access_?key|credential)"
CONTEXT = {
    EMAIL: "(?:mail|contact|kontakt|correo|courriel|write to)",
    IP: "(?:\\bip\\b|host|server|address|adresse)",
    CARD: "(?:card|visa|karte|carte|tarjeta|iban|account)",
    PHONE: "(?:phone|tel\\b|tel[.:]|call|fax|mobil|telefon|tél|móvil)",
    SECRET: "[=:]\\s*[\"']?$",
}
AGAINST = "(?:version|section|isbn|invoice|order no|chapter|figure)\\W*$"


def _running(numbers: Column, join=lambda a, b: a + b) -> Column:
    """Running sums (or what ``join`` makes) of an array from zero, in two steps so that the work stays far below the square of its size.

    ``numbers`` is named once per element: bind it with ``let`` where it is more than a variable.
    """
    step = 64

    def with_groups(sums):
        def base(g):
            return F.aggregate(F.slice(sums, F.lit(1), g), F.lit(0), join)

        return let(
            F.transform(sums, lambda _, g: base(g)),
            lambda bases: F.transform(
                numbers,
                lambda _, i: join(
                    F.get(bases, (i / step).cast("int")),
                    F.aggregate(F.slice(numbers, (i - i % step) + 1, i % step + 1), F.lit(0), join),
                ),
            ),
        )

    groups = F.filter(numbers, lambda _, i: i % step == 0)  # one place per group
    return let(F.transform(groups, lambda _, g: F.aggregate(F.slice(numbers, g * step + 1, F.lit(step)), F.lit(0), join)), with_groups)


def matches(text: Column, pattern: str, kind: int, is_open: bool = False) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, k, s, open)."""

    def placed(found):
        gaps = F.split(text, pattern, -1)
        lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda gap, s: F.length(gap) + F.length(s))
        return let(
            lengths,
            lambda own: let(
                _running(own),
                lambda ends: F.transform(
                    found,
                    lambda s, i: F.struct(
                        (F.get(ends, i) - F.length(s)).alias("start"), F.get(ends, i).alias("end"), F.lit(kind).alias("k"), s.alias("s"),
                        F.lit(is_open).alias("open"),
                    ),
                ),
            ),
        )

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _raw(text: Column, further: bool) -> Column:
    """Raw matches of every pattern; a cheap test first keeps most texts from most patterns."""
    none = F.expr("CAST(array() AS array<struct<start:int,end:int,k:int,s:string,open:boolean>>)")
    tests = [
        (text.contains("@"), PATTERNS[EMAIL], EMAIL, False), (text.rlike("[0-9]\\."), PATTERNS[IP], IP, False),
        (text.rlike("[0-9][\\x20-]?[0-9]"), PATTERNS[CARD], CARD, False), (text.contains("+"), PATTERNS[PHONE], PHONE, False),
    ]
    if further:
        tests += [
            (text.rlike("[0-9]{3}[\\x20.-][0-9]{4}"), LOCAL_PHONE, PHONE, True), (text.rlike("[\\[(]at[\\])]"), SPELLED_MAIL, EMAIL, True),
            (text.rlike("[A-Za-z0-9_]{24}"), LONG_TOKEN, SECRET, True),
        ]
    return F.concat(*[F.when(test, matches(text, pattern, kind, is_open)).otherwise(none) for test, pattern, kind, is_open in tests])


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the digit string passes the check sum."""

    def part(i):
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        doubled = d * 2
        return F.when(i % 2 == 0, d).when(doubled > 9, doubled - 9).otherwise(doubled)

    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(places, F.lit(0), lambda total, i: total + part(i)) % 10 == 0


def is_base(c: Column) -> Column:
    """Whether a raw match is a span of the four base kinds."""
    s, n = c["s"], F.length(_digits(c["s"]))
    return (
        F.when(c["open"], False)
        .when(c["k"] == EMAIL, True)
        .when(c["k"] == IP, s.rlike(f"^{OCTET}(?:\\.{OCTET}){{3}}$"))
        .when(c["k"] == CARD, F.when(n.between(14, 19), luhn(_digits(s))).otherwise(False))
        .otherwise(n.between(10, 15))
    )


def _vote(up: Column, down: Column | None = None) -> Column:
    vote = F.when(up, 1)
    return (vote if down is None else vote.when(down, -1)).otherwise(0)


def _votes(c: Column, base: Column, before: Column, after: Column) -> dict[str, Column]:
    s, k = c["s"], c["k"]
    distinct = F.size(F.array_distinct(F.split(F.regexp_replace(s, "[^0-9A-Za-z]", ""), "")))
    named = before.rlike(SECRET_NAMES + "\\W*$")
    regex = (
        F.when(base, 1)
        .when((k == PHONE) & s.rlike("^\\(?[0-9]{3}\\)?[\\x20.-][0-9]{3}[.-][0-9]{4}$"), 1)
        .when((k == EMAIL) & s.rlike("[\\[(]dot[\\])]"), 1)
        .when(k == SECRET, F.when(s.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$"), 1).when(~s.rlike("[0-9]") | ~s.rlike("[A-Za-z]"), -1).otherwise(0))
        .otherwise(-1)
    )
    gazetteer = (
        F.when(k == EMAIL, _vote(F.lower(F.regexp_extract(s, "([A-Za-z0-9-]+)$", 1)).isin(DOMAINS)))
        .when(k == IP, _vote(F.lit(False), s.rlike("^(?:0|127|255)\\.")))
        .when(k == CARD, _vote(s.rlike("^(?:4|5[1-5]|3[47]|6011|65)")))
        .when(k == PHONE, _vote(s.rlike(CALLING_CODES), s.rlike("^\\(?[01]")))
        .otherwise(_vote(named))
    )
    words = F.lit(False)
    for kind, pattern in CONTEXT.items():
        words = F.when(k == kind, before.rlike(pattern)).otherwise(words)
    return {
        "regex": regex,
        "gazetteer": gazetteer,
        "context": _vote(words, before.rlike(AGAINST)),
        "isolation": _vote(~before.rlike("[0-9A-Za-z]$") & ~after.rlike("^[0-9A-Za-z]"), F.lit(True)),
        "variety": F.when(k == SECRET, _vote(distinct >= 10, distinct < 8)).otherwise(_vote(distinct >= 4, distinct < 3)),
    }


def _overlaps(spans: Column, c: Column) -> Column:
    """Whether ``c`` overlaps one of ``spans``, which lie apart from each other in the order of the text.

    The last of them that begins before ``c`` ends is found by binary search; it alone can reach into ``c``.
    """

    def halve(s, _):
        def at(mid):
            before = F.get(spans, mid)["start"] < c["end"]
            return F.struct(F.when(before, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(before, s["hi"]).otherwise(mid).alias("hi"))

        return F.when(s["lo"] < s["hi"], let(F.shiftright(s["lo"] + s["hi"], 1), at)).otherwise(s)

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))
    begun = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi")), halve, lambda s: s["lo"])
    reaches = let(begun, lambda n: F.coalesce(F.get(spans, n - 1)["end"] > c["start"], F.lit(False)))
    return F.when(F.size(spans) == 0, False).otherwise(reaches)


def candidates(text: Column, further: bool = True) -> Column:
    """Array of (start, end, k, base, known, votes, size, digits) of a text that is not null; ``votes`` in the order of ``LABELERS``.

    ``known`` is 1 for a base span, -1 for a match of a base pattern that fails its checks, 0 for an open one.
    A candidate of the further patterns that overlaps a base span is left out. Without ``further`` only base spans come.
    """

    def judged(raw):
        marked = F.transform(raw, lambda c: c.withField("base", is_base(c)))
        return let(marked, finished)

    def finished(marked):
        sure = F.filter(marked, lambda c: c["base"])
        by_kind = F.array(*[F.filter(marked, lambda c, kind=kind: c["base"] & (c["k"] == kind)) for kind in (EMAIL, IP, CARD, PHONE)])
        rest = lambda kinds: F.filter(marked, lambda c: ~c["base"] & ~F.exists(kinds, lambda own: _overlaps(own, c)))
        every = F.concat(sure, let(by_kind, rest))
        return let(F.when(F.size(marked) > 0, text_blocks(text)), lambda blocks: described(every, blocks))

    def described(cs, blocks):
        def one(c):
            before = F.lower(block_window(blocks, c["start"] - AROUND, c["start"]))
            after = block_window(blocks, c["end"], c["end"] + 1)
            votes = let(before, lambda b: F.array(*[v.cast("int") for v in _votes(c, c["base"], b, after).values()]))
            size, digits = F.length(c["s"]), F.length(_digits(c["s"]))
            return F.struct(
                c["start"], c["end"], c["k"], c["base"],
                F.when(c["base"], 1).when(c["open"], 0).otherwise(-1).alias("known"), votes.alias("votes"),
                F.least((size / 8).cast("int"), F.lit(3)).alias("size"), F.least((digits * 4 / size).cast("int"), F.lit(3)).alias("digits"),
            )

        return F.transform(cs, one)

    if not further:
        return let(_raw(text, False), lambda raw: F.filter(F.transform(raw, lambda c: c.withField("base", is_base(c))), lambda c: c["base"]))
    return let(_raw(text, True), judged)


def histogram(docs: DataFrame, text: str = "text") -> dict[tuple, int]:
    """Candidates of all documents per (kind, known, votes, size, digits)."""
    found = docs.select(F.explode(candidates(F.coalesce(F.col(text), F.lit("")))).alias("c"))
    counts = found.groupBy("c.k", "c.known", "c.votes", "c.size", "c.digits").agg(F.count(F.lit(1)).alias("n"))
    return {(r["k"], r["known"], tuple(r["votes"]), r["size"], r["digits"]): r["n"] for r in counts.collect()}


def reliabilities(patterns: dict[tuple, int], rounds: int = 50) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """(share of true candidates, per labeler and vote its probability if true and if false) of one kind, by EM.

    ``patterns`` counts (known, votes). Starts from labelers that are right more often than not; every count is smoothed by one.
    """
    share = 0.5
    start = {1: (0.7, 0.2), 0: (0.2, 0.3), -1: (0.1, 0.5)}
    chances = [dict(start) for _ in LABELERS]
    for _ in range(rounds):
        total = [2.0, 2.0]
        seen = [{v: [p * 4 for p in start[v]] for v in start} for _ in LABELERS]
        for (known, votes), n in patterns.items():
            true = posterior(known, votes, share, chances)
            for side, weight in enumerate((true * n, (1 - true) * n)):
                total[side] += weight
                for own, vote in zip(seen, votes):
                    own[vote][side] += weight
        share = total[0] / sum(total)
        chances = [{v: tuple(own[v][side] / sum(o[side] for o in own.values()) for side in (0, 1)) for v in own} for own in seen]
    return share, chances


def posterior(known: int, votes: tuple[int, ...], share: float, chances: list[dict[int, tuple[float, float]]]) -> float:
    if known:
        return float(known > 0)
    odds = math.log(share) - math.log(1 - share)
    for own, vote in zip(chances, votes):
        odds += math.log(own[vote][0]) - math.log(own[vote][1])
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, odds))))


def _inputs(votes: tuple[int, ...], size: int, digits: int) -> list[int]:
    """Places of the active inputs: bias, one of three per labeler, size, digits."""
    return [0] + [1 + 3 * i + v + 1 for i, v in enumerate(votes)] + [16 + size, 20 + digits]


def train(counts: dict[tuple, int], rounds: int = 300, rate: float = 0.5, ridge: float = 1e-3) -> dict[int, list[float]]:
    """Weights of the span classifier per kind, fitted to the posteriors by gradient steps on the counts."""
    weights = {}
    for kind in sorted({key[0] for key in counts}):
        own = {key[1:]: n for key, n in counts.items() if key[0] == kind}
        patterns: dict[tuple, int] = {}
        for (known, votes, _, _), n in own.items():
            patterns[known, votes] = patterns.get((known, votes), 0) + n
        share, chances = reliabilities(patterns)
        # Logarithms of the counts: a common pattern teaches more than a rare one, but does not drown it.
        rows = [(_inputs(*key[1:]), posterior(key[0], key[1], share, chances), 1 + math.log(n)) for key, n in sorted(own.items())]
        total = sum(n for _, _, n in rows)
        w = [0.0] * 24
        for _ in range(rounds):
            slope = [ridge * x for x in w]
            for places, target, n in rows:
                error = 1 / (1 + math.exp(-max(-40.0, min(40.0, sum(w[p] for p in places))))) - target
                for p in places:
                    slope[p] += error * n / total
            w = [x - rate * s for x, s in zip(w, slope)]
        weights[kind] = w
    return weights


def chance(c: Column, weights: dict[int, list[float]]) -> Column:
    """The classifier's probability that a candidate is personal data."""
    score = F.lit(None).cast("double")
    for kind, w in weights.items():
        table = F.array(*[F.lit(x) for x in w])
        odds = F.lit(w[0])
        for i in range(len(LABELERS)):
            odds = odds + F.get(table, F.get(c["votes"], F.lit(i)) + (2 + 3 * i))
        odds = odds + F.get(table, c["size"] + 16) + F.get(table, c["digits"] + 20)
        score = F.when(c["k"] == kind, odds).otherwise(score)
    return F.coalesce(1 / (1 + F.exp(-score)), F.lit(0.0))


def with_spans(
    docs: DataFrame, weights: dict[int, list[float]], text: str = "text", threshold: float = THRESHOLD, name: str = "spans"
) -> DataFrame:
    """``docs`` with ``name``: array of (start, k, end, base) in the order of start and kind, base spans and added ones."""

    def chosen(cs):
        kept = F.filter(cs, lambda c: c["base"] | ((c["known"] == 0) & (chance(c, weights) >= threshold)))
        return F.array_sort(F.transform(kept, lambda c: F.struct(c["start"], c["k"], c["end"], c["base"])))

    return docs.withColumn(name, once(let(candidates(F.coalesce(F.col(text), F.lit(""))), chosen)))


def said(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.get(names, c["k"]), c["start"], c["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span, or the part of it that no earlier one covers, replaced by its kind in brackets."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def spelled(p):
        # ``at``: how far earlier spans have covered the text; a span that does not reach beyond it adds nothing.
        def part(c, i):
            at = F.when(i == 0, 0).otherwise(F.get(p["ends"], i - 1))
            kept = block_window(p["blocks"], at, F.greatest(c["start"], at))
            return F.when(c["end"] > at, F.concat(kept, F.get(names, c["k"]))).otherwise("")

        tail = block_window(p["blocks"], F.element_at(p["ends"], -1), F.length(text))
        return F.concat(F.array_join(F.transform(spans, part), ""), tail)

    ends = let(F.transform(spans, lambda c: c["end"]), lambda own: _running(own, lambda a, b: F.greatest(a, b)))
    changed = let(F.struct(ends.alias("ends"), text_blocks(text).alias("blocks")), spelled)
    return F.when(F.size(spans) == 0, text).otherwise(changed)
