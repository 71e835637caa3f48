"""Personal data and secrets: high-recall candidates, boosted trees, calibrated thresholds; all in Spark expressions.

Base spans (email, ip, card, phone) come from fixed patterns and checks and always stay. Broad
generators propose more spans, which overlap each other and the base: spelled-out addresses,
grouped numbers, digit runs, colon-separated hex groups, long mixed tokens, account numbers, private key blocks. Each candidate
has format features (digits, separators, kinds of letters, length, checksum) and context features (the characters
beside it, trigger words and assignment signs before it).

Gradient-boosted trees are learned from all documents with weak labels. Positive are candidates inside
valid base spans; hex groups in the two published address forms; account numbers whose check digits hold; mixed tokens
that are assigned to a credential's name; whole key blocks; and the addresses of a second copy of the texts, in which base e-mails are
rewritten in spelled form. Negative are failed base matches, parts of longer tokens, account numbers whose check digits fail,
other hex groups, tokens with one digit or one letter, and "x at y.z" without a spelled dot. The others are unlabelled and only scored.
A generator's threshold is the least score down to which the held-out half of the texts (by hash) shows the wanted precision;
a generator whose precision isn't shown, or that has too few labels, is off. Trees become
nested CASE expressions, so scoring is a projection: no shuffle, no Python.

What is counted are distinct feature vectors, whose number the features' ranges bound, whatever the corpus. Each generator has the same weight in the trees, so a kind
that few texts hold is learned as well. A caller may ask for a bounded sample instead (``sample_docs``), with the same number of texts for each kind (``DRAWN``).
Of spelled-out addresses the name has at most 64 and a label of the host at most 63 characters, the limits of the format; nothing else is bounded.

Patterns use possessive quantifiers and look-behinds, which find the same leftmost matches as
the plain patterns but in linear time on long tokens.

Defined cases: null text is empty; positions count code points, ends are exclusive; equal rows
get equal spans; texts of any length are searched whole; without labelled candidates nothing is added to the base; an empty table
gives an empty result; further columns are ignored or pass through, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEPT, carry, give_back, settle, text_of

# Kinds in their order, and their patterns.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "spelled_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?: at |\x20?\(at\)\x20?|\x20?\[at\]\x20?)[A-Za-z0-9-]{1,63}+(?:(?: dot |\x20?\(dot\)\x20?|\x20?\[dot\]\x20?|\.)[A-Za-z0-9-]{1,63}+){1,5}+",
    "grouped_number": r"(?<![0-9])\(?[0-9]{2,5}+\)?(?:[\x20./-][0-9]{2,6}+){1,6}+",
    "digit_run": r"(?<![0-9])[0-9]{8,}+",
    "hex_groups": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){3,7}+[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])",
    "secret": r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])(?=[0-9_/+-]*+[A-Za-z])[A-Za-z0-9_/+-]{16,}+={0,2}+",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3}(?![A-Za-z0-9]))?+(?![A-Za-z0-9])",
    "key_block": r"-----BEGIN [A-Z0-9 ]{0,40}?PRIVATE KEY(?: BLOCK)?-----[^-]*+(?:-----END [A-Z0-9 ]{0,40}?PRIVATE KEY(?: BLOCK)?-----)?+",
}
# What of a kind a text must hold to be drawn for its part of the sample.
DRAWN = {
    "email": "@",
    "phone": r"\+[0-9]",
    "spelled_email": r" at |\(at\)|\[at\]",
    "grouped_number": r"[0-9][\x20./-][0-9]",
    "digit_run": r"[0-9]{8}",
    "hex_groups": r"(?::[0-9A-Fa-f]{1,4}){3}",
    "secret": r"[=:]\s{0,3}[\x22']?[A-Za-z0-9_/+-]{16}",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}",
    "key_block": "PRIVATE KEY",
}
TRIGGERS = r"(?i)\b(phone|tel|telephone|call|mobile|fax|cell|contact|mail|e-mail|email|write|reach|card|visa|iban|account|ssn|id|ip|host|server|address|passport)\b[^A-Za-z0-9]{0,4}$"
CREDENTIALS = r"(?i)(?:token|secret|passw(?:or)?d|credential|bearer|auth|(?:api|access|private|secret)[_ -]?key)[A-Za-z_]{0,8}[\x22']?\s{0,3}[=:]?\s{0,3}[\x22']?$"
ASSIGNED = r"[=:]\s{0,3}[\x22']?$"
KINDS = [*BASE, *GENERATORS]
FEATURES = ["generator", "digits", "marks", "letters", "distinct", "checksum", "left", "right", "trigger", "length", "credential", "assigned"]
PRECISION = 0.95
LEAST_LABELS = 5
OFF = 2.0
BLOCK = 256
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
ITEM = "array<struct<start: int, stop: int, hit: string, before: string, after: string>>"
SPAN = "array<struct<start: int, rank: int, stop: int>>"


def _blocks(kind: str) -> Column:
    """Matches of h_<kind> with the gaps of g_<kind> beside them, in blocks of BLOCK."""
    hits, gaps = F.col(f"h_{kind}"), F.col(f"g_{kind}")

    def one(k: Column) -> Column:
        beside = F.zip_with(
            F.slice(gaps, k, F.lit(BLOCK)),
            F.slice(gaps, k + 1, F.lit(BLOCK)),
            lambda a, b: F.struct(F.char_length(a).alias("gap"), F.right(a, F.lit(24)).alias("before"), F.left(b, F.lit(1)).alias("after")),
        )
        own = F.slice(hits, k, F.lit(BLOCK))
        return F.zip_with(
            F.slice(beside, F.lit(1), F.size(own)),
            own,
            lambda g, h: F.struct(g["gap"].alias("gap"), F.char_length(h).alias("n"), h.alias("hit"), g["before"].alias("before"), g["after"].alias("after")),
        )

    return F.when(F.size(hits) > 0, F.transform(F.sequence(F.lit(1), F.size(hits), F.lit(BLOCK)), one)).otherwise(F.array())


def _placed(kind: str) -> Column:
    """Array of (start, stop, hit, before, after), from b_<kind>. The running sums go by blocks, so a
    text with very many matches costs no square of them."""
    blocks = F.col(f"b_{kind}")

    def place(block: Column, base: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(base.alias("at"), F.array().cast(ITEM).alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + x["gap"] + x["n"]).alias("at"),
                F.concat(
                    acc["out"],
                    F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["n"]).alias("stop"), x["hit"].alias("hit"), x["before"].alias("before"), x["after"].alias("after"))),
                ).alias("out"),
            ),
            lambda acc: acc["out"],
        )

    lengths = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x["gap"] + x["n"]))
    bases = F.aggregate(lengths, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    return F.when(F.size(blocks) > 0, F.flatten(F.zip_with(blocks, F.slice(bases, F.lit(1), F.size(blocks)), place))).otherwise(F.array().cast(ITEM))


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Checksum test of a string of digits; false if it is empty."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        double = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, double).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add)
    return F.when(F.char_length(digits) > 0, total % 10 == 0).otherwise(F.lit(False))


def valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.regexp_like(hit, F.lit(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
    n = F.char_length(digits_of(hit))
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), luhn(digits_of(hit))).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def with_matches(rows: DataFrame, *keep: str) -> DataFrame:
    """Columns ``keep`` of ``rows`` (which have a column text without nulls), then m_<kind> for every base kind and generator."""
    t = F.col("text")
    has = lambda *parts: reduce(lambda a, b: a | b, (F.contains(t, F.lit(x)) for x in parts))
    digit = F.regexp_like(t, F.lit("[0-9]"))
    # Each is a necessary condition of its pattern.
    present = {"email": has("@"), "phone": has("+"), "spelled_email": has(" at ", "(at)", "[at]"), "hex_groups": has(":"), "key_block": has("PRIVATE KEY")}
    patterns = BASE | GENERATORS
    # Step by step, so that no pattern runs twice; only texts with a match are split.
    rows = rows.withColumns({f"h_{k}": F.when(present.get(k, digit), F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>")) for k, p in patterns.items()})
    rows = rows.withColumns({f"g_{k}": F.when(F.size(f"h_{k}") > 0, F.split(t, p, -1)).otherwise(F.array().cast("array<string>")) for k, p in patterns.items()})
    rows = rows.select(*keep, *(f"h_{k}" for k in patterns), *(f"g_{k}" for k in patterns))
    rows = rows.withColumns({f"b_{k}": _blocks(k) for k in patterns})
    return rows.select(*keep, *(_placed(k).alias(f"m_{k}") for k in patterns))


def base_spans() -> Column:
    """Sorted array of (start, rank, stop) of the valid base spans, from the m_ columns."""

    def of(rank: int, kind: str) -> Column:
        good = F.filter(f"m_{kind}", lambda x: valid(kind, x["hit"]))
        return F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["stop"].alias("stop")))

    parts = [of(i, k) for i, k in enumerate(BASE)]
    return F.array_sort(F.concat(*parts))


def _side(c: Column) -> Column:
    return F.when(c.isNull() | F.regexp_like(c, F.lit(r"^\s?$")), 0).when(F.regexp_like(c, F.lit(r"^[\p{L}\p{N}_]$")), 2).otherwise(1)


def _features(x: Column) -> Column:
    digits = x["digits"]
    n = F.char_length(digits)
    steps = lambda c, *cuts: F.size(F.filter(F.array(*(F.lit(k) for k in cuts)), lambda k: c >= k))
    values = [
        x["rank"],
        steps(n, 4, 8, 9, 10, 12, 16, 20),
        F.least(F.char_length(F.regexp_replace(x["hit"], "[A-Za-z0-9]", "")), F.lit(5)),
        F.regexp_like(x["hit"], F.lit("[a-z]")).cast("int") + 2 * F.regexp_like(x["hit"], F.lit("[A-Z]")).cast("int"),
        steps(F.size(F.array_distinct(F.split(F.left(digits, F.lit(32)), ""))), 3, 5, 7),
        F.when(x["rank"] == KINDS.index("account"), check_digits(x["hit"])).when((n >= 12) & (n <= 19), luhn(digits)).otherwise(F.lit(False)).cast("int"),
        _side(F.right(x["before"], F.lit(1))),
        _side(x["after"]),
        F.regexp_like(x["before"], F.lit(TRIGGERS)).cast("int"),
        steps(F.char_length(x["hit"]), 12, 20, 32, 40, 64),
        F.regexp_like(x["before"], F.lit(CREDENTIALS)).cast("int"),
        F.regexp_like(x["before"], F.lit(ASSIGNED)).cast("int"),
    ]
    return F.struct(*(v.alias(n) for n, v in zip(FEATURES, values)))


def check_digits(hit: Column) -> Column:
    """Whether an international account number leaves 1 modulo 97, its first four characters taken last."""
    plain = F.regexp_replace(hit, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.char_length(plain)), F.left(plain, F.lit(4)))

    def add(acc: Column, c: Column) -> Column:
        n = F.ascii(c)
        return F.when(n >= 65, acc * 100 + n - 55).otherwise(acc * 10 + n - 48) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(add(acc, c))) == 1


def own_label(kind: str, x: Column) -> Column:
    """What a generator's candidate shows by itself: 1, 0 or null."""
    hit = x["hit"]
    if kind == "spelled_email":
        return F.when(~F.regexp_like(hit, F.lit(r"[\[(]at[)\]]| dot |[\[(]dot[)\]]")), 0)
    if kind == "hex_groups":
        return F.regexp_like(hit, F.lit(r"^(?:(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4})$")).cast("int")
    if kind == "account":
        return check_digits(hit).cast("int")
    if kind == "key_block":
        return F.when(F.regexp_like(hit, F.lit("-----END .*-----$")), 1)
    if kind == "secret":
        few = ~F.regexp_like(hit, F.lit("[0-9][^0-9]*[0-9]")) | ~F.regexp_like(hit, F.lit("[A-Za-z][^A-Za-z]*[A-Za-z]"))
        return F.when(few, 0).when(F.regexp_like(x["before"], F.lit(CREDENTIALS)) & F.regexp_like(x["before"], F.lit(ASSIGNED)), 1)
    return F.lit(None).cast("int")


def candidates(kinds: list[str], learning: bool) -> Column:
    """Array of (start, rank, stop, f: features) of the matches of ``kinds``; for learning also ok (a base match passes its
    check) and shows (``own_label``)."""

    def of(kind: str) -> Column:
        def one(x: Column) -> Column:
            more = []
            if learning:
                more = [(valid(kind, x["hit"]) if kind in BASE else F.lit(None).cast("boolean")).alias("ok"), (own_label(kind, x) if kind in GENERATORS else F.lit(None).cast("int")).alias("shows")]
            return F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["stop"].alias("stop"), x["hit"].alias("hit"), x["before"].alias("before"), x["after"].alias("after"), digits_of(x["hit"]).alias("digits"), *more)

        return F.transform(f"m_{kind}", one)

    more = ["ok", "shows"] * learning
    every = F.concat(*(of(k) for k in kinds))
    return F.transform(every, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["stop"].alias("stop"), *(x[m].alias(m) for m in more), _features(x).alias("f")))


@dataclass
class Trees:
    """Boosted trees over small integer features: nested (feature, cut, low, high) or a leaf number."""

    bias: float = 0.0
    trees: list = field(default_factory=list)
    thresholds: dict[int, float] = field(default_factory=dict)  # by rank of the generator

    def margin(self, row: tuple) -> float:
        def walk(node):
            while isinstance(node, tuple):
                node = node[2] if row[node[0]] < node[1] else node[3]
            return node

        return self.bias + sum(walk(t) for t in self.trees)

    def score(self, row: tuple) -> float:
        return 1 / (1 + math.exp(-self.margin(row)))

    def expression(self, f: Column) -> Column:
        def walk(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            return F.when(f[FEATURES[node[0]]] < node[1], walk(node[2])).otherwise(walk(node[3]))

        total = F.lit(float(self.bias))
        for t in self.trees:
            total = total + walk(t)
        return 1 / (1 + F.exp(-total))


def boost(rows: list[tuple[tuple, float, float]], rounds: int = 16, depth: int = 3, rate: float = 0.4, damping: float = 1.0) -> Trees:
    """Newton boosting of the log loss on (features, positives, count) rows."""
    pos, n = sum(r[1] for r in rows), sum(r[2] for r in rows)
    out = Trees(math.log((pos + 0.5) / (n - pos + 0.5)))
    if not 0 < pos < n:
        return out
    x = np.array([r[0] for r in rows], np.int64)
    y, count = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    margin = np.full(len(rows), out.bias)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p * count - y, p * (1 - p) * count

        def grow(ids: np.ndarray, left: int):
            sg, sh = g[ids].sum(), h[ids].sum()
            best = (1e-6, None)
            for j in range(len(FEATURES)) if left else ():
                values, place = np.unique(x[ids, j], return_inverse=True)
                lg, lh = np.bincount(place, g[ids]).cumsum()[:-1], np.bincount(place, h[ids]).cumsum()[:-1]
                gain = lg * lg / (lh + damping) + (sg - lg) ** 2 / (sh - lh + damping) - sg * sg / (sh + damping)
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), (j, int(values[gain.argmax() + 1])))
            if not best[1]:
                leaf = float(-rate * sg / (sh + damping))
                margin[ids] += leaf
                return leaf
            j, cut = best[1]
            low = x[ids, j] < cut
            return (j, cut, grow(ids[low], left - 1), grow(ids[~low], left - 1))

        out.trees.append(grow(np.arange(len(rows)), depth))
    return out


def even(rows: list[tuple[tuple, float, float]]) -> list[tuple[tuple, float, float]]:
    """(features, positives, count) rows so weighted that each generator has the same number of labels in all."""
    each: dict[int, float] = {}
    for f, _, n in rows:
        each[f[0]] = each.get(f[0], 0.0) + n
    whole = sum(each.values()) / max(1, len(each))
    return [(f, y * whole / each[f[0]], n * whole / each[f[0]]) for f, y, n in rows]


def _sample(docs: DataFrame, most: int) -> DataFrame:
    """hash and text of at most ``most`` distinct texts. Each kind of ``DRAWN`` has an equal part of them, however rare it is: of the texts
    that may hold it, those with the least hash. A first pass estimates how many there are of each kind, a second one
    takes little more than the texts that are needed."""
    each = max(1, most // len(DRAWN))
    rows = docs.select(text_of(docs)).select("text", F.xxhash64("text").alias("hash"), *(F.regexp_like("text", F.lit(p)).alias(k) for k, p in DRAWN.items()))
    known = rows.agg(*(F.approx_count_distinct(F.when(F.col(k), F.col("hash"))).alias(k) for k in DRAWN)).first()
    span, least = 1 << 64, -(1 << 63)
    # Twice the texts that are wanted and 64 more: an estimate that is off by its usual few percent still leaves enough.
    last = {k: min(span - 1, span * 2 * (each + 32) // known[k]) + least for k in DRAWN if known[k]}
    near = reduce(lambda a, b: a | b, (F.col(k) & (F.col("hash") <= last[k]) for k in last), F.lit(False))
    found = settle(rows.filter(near).groupBy("hash").agg(F.first("text").alias("text"), *(F.first(k).alias(k) for k in DRAWN)))
    chosen = [found.filter(k).select("hash").orderBy("hash").limit(each) for k in DRAWN]
    return settle(found.join(reduce(DataFrame.union, chosen).distinct(), "hash", "left_semi").select("hash", "text"))


def _calibrated(scored: list[tuple[float, int, int]], precision: float) -> float:
    """The least score down to which (score, positives, count) rows have the precision; ``OFF`` if there is none."""
    threshold, pos, n = OFF, 0, 0
    by_score: dict[float, list[int]] = {}
    for score, p, m in scored:
        found = by_score.setdefault(round(score, 9), [0, 0])
        found[0] += p
        found[1] += m
    for score in sorted(by_score, reverse=True):
        pos, n = pos + by_score[score][0], n + by_score[score][1]
        if n >= LEAST_LABELS and pos >= precision * n:
            threshold = score - 1e-6  # the rounded score, and Spark's own arithmetic
    return max(threshold, 0.5)


def fit(docs: DataFrame, sample_docs: int | None = None, precision: float = PRECISION) -> Trees:
    """Learn from the candidates of all texts, and of their copies with spelled e-mails; of at most ``sample_docs`` texts only if that is asked for.

    What reaches the driver are the distinct feature vectors, whose number the features' ranges bound.
    """
    sample = docs.select(text_of(docs)).select(F.xxhash64("text").alias("hash"), "text").filter("text is not null") if sample_docs is None else _sample(docs, sample_docs)
    form = F.when(F.pmod("hash", F.lit(6)) < 3, " at ").when(F.pmod("hash", F.lit(6)) < 5, " (at) ").otherwise("[at]")
    dot = F.when(F.pmod("hash", F.lit(6)) < 3, " dot ").when(F.pmod("hash", F.lit(6)) < 5, " (dot) ").otherwise("[dot]")
    spelled = F.regexp_replace("text", F.lit(r"([A-Za-z0-9._%+-]{1,64}+)@([A-Za-z0-9-]{1,63}+)\.([A-Za-z0-9-]{1,63}+)"), F.concat(F.lit("$1"), form, F.lit("$2"), dot, F.lit("$3")))
    copies = sample.filter(F.contains("text", F.lit("@"))).select("hash", spelled.alias("text"), F.lit(True).alias("copy"))
    rows = sample.select("hash", "text", F.lit(False).alias("copy")).unionAll(copies)
    rows = settle(with_matches(rows, "hash", "copy").select("hash", "copy", base_spans().alias("base"), candidates(KINDS, True).alias("c")))
    is_spelled = KINDS.index("spelled_email")

    def labelled(x: Column) -> Column:
        inside = F.exists("base", lambda b: (b["start"] <= x["start"]) & (x["stop"] <= b["stop"]))
        failed = F.exists("failed", lambda y: (y["start"] <= x["start"]) & (x["stop"] <= y["stop"]))
        part_of = ((x["f"]["left"] == 2) | (x["f"]["right"] == 2)) & (x["rank"] != KINDS.index("secret"))
        label = F.when(F.col("copy"), F.when((x["rank"] == is_spelled) & x["shows"].isNull(), 1)).when(x["shows"].isNotNull(), x["shows"])
        return F.struct(x["f"].alias("f"), label.when(inside, 1).when(failed | part_of, 0).alias("y"))

    # Labelled within their arrays: a row of each candidate that carried them would square a text's number of candidates.
    rows = rows.withColumn("failed", F.filter("c", lambda y: F.coalesce(~y["ok"], F.lit(False)))).select("hash", F.filter(F.transform("c", labelled), lambda x: x["y"].isNotNull()).alias("c"))
    seen = rows.select((F.pmod("hash", F.lit(2)) == 0).alias("held"), F.explode("c").alias("x")).select("held", "x.f.*", "x.y")
    table = seen.groupBy("held", *FEATURES).agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n")).orderBy("held", *FEATURES).collect()
    vector = lambda r: tuple(r[f] for f in FEATURES)
    learn = [(vector(r), float(r["pos"]), float(r["n"])) for r in table if not r["held"]]
    model = boost(even(learn)) if learn else Trees(-10.0)
    for rank in range(len(BASE), len(KINDS)):
        model.thresholds[rank] = _calibrated([(model.score(vector(r)), r["pos"], r["n"]) for r in table if r["held"] and r["generator"] == rank], precision)
    return model


def _kept(items: Column, begin: Column, advance: Callable, keep: Callable) -> Column:
    """The items that ``keep``(state, item) takes, in their order; the state, a number, goes on by ``advance``. By blocks, so
    that very many spans cost no square of their number."""
    blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(BLOCK)), lambda k: F.slice(items, k, F.lit(BLOCK)))
    states = F.aggregate(blocks, F.array(begin), lambda acc, b: F.concat(acc, F.array(F.aggregate(b, F.element_at(acc, -1), advance))))

    def one(block: Column, state: Column) -> Column:
        none = F.array().cast("array<struct<start: int, rank: int, stop: int>>")
        return F.aggregate(
            block,
            F.struct(state.alias("state"), none.alias("out")),
            lambda acc, x: F.struct(advance(acc["state"], x).alias("state"), F.when(keep(acc["state"], x), F.concat(acc["out"], F.array(x))).otherwise(acc["out"]).alias("out")),
            lambda acc: acc["out"],
        )

    return F.flatten(F.zip_with(blocks, F.slice(states, F.lit(1), F.size(blocks)), one))


def _added(rows: DataFrame, model: Trees) -> DataFrame:
    """Column all_spans: the base spans and the selected candidates that touch neither them nor an earlier one, sorted."""
    on = {k: model.thresholds.get(KINDS.index(k), OFF) for k in GENERATORS}
    on = {k: v for k, v in on.items() if v <= 1}
    if not on:
        return rows.withColumn("all_spans", F.col("base_spans"))
    threshold = F.create_map(*(F.lit(v) for k in on for v in (KINDS.index(k), on[k])))
    scored = F.filter(candidates(list(on), False), lambda x: model.expression(x["f"]) >= F.element_at(threshold, x["rank"]))
    rows = rows.withColumn("chosen", F.transform(scored, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["stop"].alias("stop"))))
    base = lambda x: x["rank"] < len(BASE)
    # From the back: what reaches into a base span that begins at it or later goes. Then from the front: what begins within one, or within a chosen one.
    rows = rows.withColumn("falling", F.reverse(F.array_sort(F.transform(F.concat("base_spans", "chosen"), lambda x: F.struct(x["start"].alias("start"), (-x["rank"]).alias("rank"), x["stop"].alias("stop"))))))
    falling = lambda x: x["rank"] > -len(BASE)
    back = _kept(F.col("falling"), F.lit(2147483647), lambda s, x: F.when(falling(x), x["start"]).otherwise(s), lambda s, x: falling(x) | (x["stop"] <= s))
    rows = rows.withColumn("rising", F.array_sort(F.transform(back, lambda x: F.struct(x["start"].alias("start"), (-x["rank"]).alias("rank"), x["stop"].alias("stop")))))
    front = _kept(F.col("rising"), F.lit(0), lambda s, x: F.when(base(x) | (x["start"] >= s), F.greatest(s, x["stop"])).otherwise(s), lambda s, x: base(x) | (x["start"] >= s))
    return rows.withColumn("all_spans", F.when(F.size("chosen") > 0, front).otherwise(F.col("base_spans")))


def find(docs: DataFrame, model: Trees | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The caller's columns ``keep`` as one, base_spans and all_spans (sorted arrays of start, rank in KINDS, stop)."""
    model = model or fit(docs)
    text = F.coalesce(text_of(docs), F.lit("")).alias("text")
    rows = with_matches(carry(docs, list(keep), text), KEPT).withColumn("base_spans", base_spans())
    return _added(rows, model).select(KEPT, "base_spans", "all_spans")


def said(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["rank"] + 1), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def report(docs: DataFrame, model: Trees | None = None) -> DataFrame:
    """Per row: doc_id, counts of the base kinds, digest of the base spans, all spans, and the number of added ones."""
    found = find(docs, model)

    def count(rank: int) -> Column:
        return F.size(F.filter("base_spans", lambda x: x["rank"] == rank)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(BASE)]
    added = (F.size("all_spans") - F.size("base_spans")).cast("long").alias("n_added")
    return give_back(found, ["doc_id"], *counts, F.sha2(said(F.col("base_spans")), 256).alias("base_sha256"), said(F.col("all_spans")).alias("spans"), added)


def redact(docs: DataFrame, model: Trees | None = None) -> DataFrame:
    """All columns of ``docs``, every span of the text replaced by its kind in angle brackets (of overlapping spans, the first)."""
    names = docs.columns
    found = find(docs, model, tuple(names))
    labels = F.array(*(F.lit(f"<{k}>") for k in KINDS))
    old = F.col(KEPT).getField("text")
    text = F.coalesce(old.cast("string"), F.lit(""))
    # Spans that overlap are one, which begins with the first one's kind and ends with the last end.
    found = found.withColumn("first", _kept(F.col("all_spans"), F.lit(0), lambda s, x: F.greatest(s, x["stop"]), lambda s, x: x["start"] >= s))
    by_stop = F.reverse(F.array_sort(F.transform("all_spans", lambda x: F.struct(x["stop"].alias("start"), x["start"].alias("rank"), x["stop"].alias("stop")))))
    found = found.withColumn("by_stop", by_stop)
    last = _kept(F.col("by_stop"), F.lit(2147483647), lambda s, x: F.least(s, x["rank"]), lambda s, x: x["stop"] <= s)
    found = found.withColumn("stops", F.transform(F.reverse(last), lambda x: x["stop"])).withColumn("starts", F.transform("first", lambda x: x["start"]))
    one = F.zip_with("first", "stops", lambda x, stop: F.struct(x["rank"].alias("rank"), stop.alias("stop")))
    pieces = F.zip_with(one, F.slice("starts", F.lit(2), F.size("starts")), lambda x, after: F.concat(F.element_at(labels, x["rank"] + 1), F.substring(text, x["stop"] + 1, F.coalesce(after, F.char_length(text)) - x["stop"])))
    cut = F.concat(F.substring(text, F.lit(1), F.get("starts", F.lit(0))), F.array_join(pieces, ""))
    new = F.when(F.size("all_spans") > 0, cut).otherwise(old)
    return found.select(*((new if c == "text" else F.col(KEPT).getField(c)).alias(c) for c in names))
