"""Personal data: overlapping candidates, boosted trees over format and context, calibrated selection; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from math import exp, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm.common import crc_mod, documents, let

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Leading runs are possessive and begin at a run's start or where the last match ended, which finds
#: the same leftmost matches as a plain quantifier without going over a long run again from each of its characters.
_MAIL, _DOM = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:\G|(?<!{_MAIL})){_MAIL}++@{_DOM}++(?:\.{_DOM}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold to have a match that passes: one quick test, after which most texts are done.
_HINT = {"email": "@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
#: High-recall candidates: the base forms, their usual disguises, and much that only looks like them.
_AT, _DOT = r"(?:@|\x20?[(\[{]\x20?(?i:at)\x20?[)\]}]\x20?|\x20(?i:at)\x20)", r"(?:\.|\x20?[(\[{]\x20?(?i:dot)\x20?[)\]}]\x20?|\x20(?i:dot)\x20)"
CANDIDATES = {
    "email": rf"(?<!{_MAIL}){_MAIL}++{_AT}{_DOM}++(?:{_DOT}{_DOM}++){{1,6}}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\)|\x20\.\x20)[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20._/\xA0-]{0,2}[0-9]{2,6}){2,4}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+|00)?\(?[0-9]{1,4}\)?(?:[\x20()./\xA0-]{1,2}[0-9]{2,5}){2,4}(?![0-9])",
}
_CANDIDATE_HINT = {
    "email": r"@[A-Za-z0-9-]|[\x20(\[{](?i:at)[\x20)\]}]",
    "ip": r"[0-9](?:\.|\[\.\]|\(\.\)|\x20\.\x20)[0-9]{1,3}(?:\.|\[\.\]|\(\.\)|\x20\.\x20)[0-9]",
    "card": r"[0-9]{4}[\x20._/\xA0-]{0,2}[0-9]{2,6}[\x20._/\xA0-]{0,2}[0-9]{2}",
    "phone": r"[0-9]\)?[\x20()./\xA0-]{1,2}[0-9]{2,5}[\x20()./\xA0-]{1,2}[0-9]{2}",
}
#: Words shortly in front of a value of the kind.
CONTEXT = {
    "email": r"(?i)(mail|write to|contact|kontakt|schreib|correo|courriel|address|adress|direcc)[^\n]{0,24}$",
    "ip": r"(?i)(\bip\b|ipv4|host|server|address|adress|direcc|login|gateway)[^\n]{0,24}$",
    "card": r"(?i)(card|visa|master|kart|tarjet|carte|credit|kredit|amex)[^\n]{0,24}$",
    "phone": r"(?i)(tel|phone|fax|mobil|call|ring|anruf|handy|llam|appel|whatsapp)[^\n]{0,24}$",
}
#: Forms that nobody writes by chance: the at and the dots of an address in brackets, four groups of four digits.
DELIBERATE = {
    "email": r"^[^@]*[(\[{]\x20?(?i:at)\x20?[)\]}]",
    "ip": r"\[\.\]|\(\.\)",
    "card": r"^[0-9]{4}(?:[._/\xA0-]{1,2}[0-9]{4}){3}$",
    "phone": r"^(?:\+|00)[0-9]{1,3}[\x20(]",
}
#: Values that each feature of a candidate takes, 0 up to this.
FEATURES = {"kind": 4, "form": 3, "digits": 6, "gaps": 4, "left": 4, "right": 4, "context": 2, "tail": 3, "lead": 3}
#: What each of the two views of a candidate sees of them; neither sees the other's label, see ``fit_on``.
FORMAT, AROUND = ("kind", "form", "digits", "gaps", "tail", "lead"), ("kind", "left", "right", "context")
SPAN = "struct<start:int,kind:int,stop:int>"
#: Items that one fold takes; see ``scan``.
BLOCK = 64


def scan(items: Column, state: Column, step: Callable[[Column, Column], Column], out: str) -> Column:
    """All that ``step(state, item)``, a struct of the next state ``s`` and an array ``o`` of type ``out``, gives on the way over
    ``items``. Arrays grow by copies, so blocks are folded apart and joined in the end: linear in all practical numbers."""
    none, several = F.array().cast(f"array<{out}>"), F.array().cast(f"array<array<{out}>>")

    def fold(block: Column, s: Column) -> Column:
        grow = lambda acc, x: let(step(acc["s"], x), lambda r: F.struct(r["s"].alias("s"), F.concat(acc["o"], r["o"]).alias("o")))
        return F.aggregate(block, F.struct(s.alias("s"), none.alias("o")), grow)

    join = lambda acc, b: let(fold(b, acc["s"]), lambda r: F.struct(r["s"].alias("s"), F.concat(acc["o"], F.array(r["o"])).alias("o")))
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.shiftright(F.size(x) - 1, 6)), lambda b: F.slice(x, b * BLOCK + 1, F.lit(BLOCK)))
    over = lambda x: F.flatten(F.aggregate(cut(x), F.struct(state.alias("s"), several.alias("o")), join)["o"])
    return let(items, lambda x: F.when(F.size(x) > 0, over(x)).otherwise(none))


def found_spans(text: Column, pattern: str, hint: str) -> Column:
    """Every match as (start, stop, value, left, right): code points, the end exclusive, and the text beside it,
    which reaches back to the match before at most.

    Splitting at the pattern gives what lies between the matches; lengths add up to positions.
    """
    kind = "struct<start:int,stop:int,value:string,left:string,right:string>"

    def paired(hits: Column, between: Column) -> Column:
        beside = F.arrays_zip(F.slice(between, F.lit(1), F.size(hits)).alias("before"), F.slice(between, F.lit(2), F.size(hits)).alias("after"))
        return F.zip_with(hits, beside, lambda v, b: F.struct(v.alias("value"), b["before"].alias("before"), b["after"].alias("after")))

    def step(at: Column, x: Column) -> Column:
        start = at + F.length(x["before"])
        stop = start + F.length(x["value"])
        span = F.struct(start.alias("start"), stop.alias("stop"), x["value"].alias("value"), F.substring(x["before"], -40, 40).alias("left"), F.substring(x["after"], 1, 1).alias("right"))
        return F.struct(stop.alias("s"), F.array(span).alias("o"))

    pairs = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda h: let(F.split(text, pattern, -1), lambda b: paired(h, b)))
    return F.when(text.rlike(hint), scan(pairs, F.lit(0), step, kind)).otherwise(F.array().cast(f"array<{kind}>"))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a valid check digit."""

    def term(i: Column) -> Column:
        x = F.substring(number, F.length(number) - i, F.lit(1)).cast("int") * (1 + i % 2)
        return F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), lambda a, i: a + term(i)) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """The test of a base match; disguises are tested by their digits."""
    if kind == "email":
        return F.lit(True)
    d = digits(value)
    if kind == "ip":
        parts = F.transform(F.split(value, r"[^0-9]+"), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(F.concat(F.lit("00"), p), -3, 3) <= "255"))
    if kind == "card":
        return F.when((F.length(d) >= 14) & (F.length(d) <= 19), luhn(d)).otherwise(F.lit(False))
    return F.length(d).between(10, 15)


def base_spans(text: Column) -> Column:
    """Array of (start, kind number, stop) of the base matches that pass, by start and kind."""

    def of(k: int, kind: str) -> Column:
        kept = F.filter(found_spans(text, BASE[kind], _HINT[kind]), lambda s: valid(kind, s["value"]))
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["stop"].alias("stop")))

    return F.array_sort(F.concat(*(of(k, kind) for k, kind in enumerate(KINDS))))


def char_class(c: Column) -> Column:
    """0 nothing or white space, 1 punctuation, 2 letter, 3 digit."""
    return F.when(F.coalesce(c, F.lit("")).rlike(r"^\s*$"), 0).when(c.rlike("[0-9]"), 3).when(c.rlike(r"\p{L}"), 2).otherwise(1)


def plausible(kind: str, value: Column) -> Column:
    """What a candidate must be to be added: an address ends in a name of two letters or more, the others pass ``valid``."""
    return value.rlike(r"(?:\.|[dD][oO][tT][\x20)\]}]{1,2})[A-Za-z]{2,}$") if kind == "email" else valid(kind, value)


def described(k: int, kind: str, s: Column) -> Column:
    """A candidate's binned features."""
    v = s["value"]
    n, gaps = F.length(digits(v)), F.length(F.regexp_replace(v, r"[A-Za-z0-9]+", ""))
    features = {
        "kind": F.lit(k),
        "form": F.when(v.rlike("^(?:" + BASE[kind].replace(r"\G|", "") + ")$"), 0).when(v.rlike(DELIBERATE[kind]), 1).otherwise(2),
        "digits": F.when(n == 0, 0).when(n < 10, 1).when(n < 14, 2).when(n < 16, 3).when(n == 16, 4).otherwise(5),
        "gaps": F.when(gaps == 0, 0).when(gaps < 3, 1).when(gaps < 5, 2).otherwise(3),
        "left": char_class(F.substring(s["left"], -1, 1)),
        "right": char_class(s["right"]),
        "context": s["left"].rlike(CONTEXT[kind]).cast("int"),
        "tail": F.when(v.rlike("[A-Za-z]{2}$"), 2).when(v.rlike("[A-Za-z]$"), 1).otherwise(0),
        "lead": F.when(v.rlike(r"^\+"), 2).when(v.rlike(r"^[(0]"), 1).otherwise(0),
    }
    return F.struct(*(x.cast("int").alias(f) for f, x in features.items()))


def evidence(text: Column) -> Column:
    """For every candidate its features ``f`` and whether it passes its kind's test, ``passed``."""

    def of(k: int, kind: str) -> Column:
        one = lambda s: F.struct(described(k, kind, s).alias("f"), plausible(kind, s["value"]).alias("passed"))
        return F.transform(found_spans(text, CANDIDATES[kind], _CANDIDATE_HINT[kind]), one)

    return F.concat(*(of(k, kind) for k, kind in enumerate(KINDS)))


@dataclass(frozen=True)
class Tree:
    """Tests ``feature <= value``, a few levels deep; leaves add to the log-odds."""

    feature: str | None
    value: int
    low: Tree | float
    high: Tree | float

    def column(self, f: Column) -> Column:
        side = [x.column(f) if isinstance(x, Tree) else F.lit(float(x)) for x in (self.low, self.high)]
        return F.when(f[self.feature] <= self.value, side[0]).otherwise(side[1])

    def of(self, row: dict[str, int]) -> float:
        side = self.low if row[self.feature] <= self.value else self.high
        return side.of(row) if isinstance(side, Tree) else side


@dataclass(frozen=True)
class SpanModel:
    """Boosted trees, and for each kind the least score at which a candidate is added (infinite: never). Where ``around``, the
    view of the surroundings, clears its own threshold by less, the score is lowered to that: both must agree."""

    start: float
    trees: tuple[Tree, ...]
    thresholds: tuple[float, ...]
    around: SpanModel | None = None

    def score(self, f: Column, k: int) -> Column:
        own = reduce(lambda a, t: a + t.column(f), self.trees, F.lit(float(self.start)))
        return own if self.around is None else F.least(own, F.lit(self.thresholds[k]) + (self.around.score(f, k) - F.lit(self.around.thresholds[k])))

    def of(self, row: dict[str, int]) -> float:
        own, k = reduce(lambda a, t: a + t.of(row), self.trees, float(self.start)), row["kind"]
        return own if self.around is None or self.thresholds[k] == float("inf") else min(own, self.thresholds[k] + (self.around.of(row) - self.around.thresholds[k]))


Cell = tuple[dict[str, int], float, float]


def boost(cells: list[Cell], features: tuple[str, ...] = tuple(FEATURES), rounds: int = 24, rate: float = 0.3, depth: int = 3, ridge: float = 5.0) -> tuple[float, tuple[Tree, ...]]:
    """Newton boosting over ``features`` on a table of (features, with the label, without) counts, one row for each combination met."""
    total = [sum(p for _, p, _ in cells), sum(n for _, _, n in cells)]
    start = log((total[0] + 1) / (total[1] + 1))
    score = [start] * len(cells)
    trees: list[Tree] = []

    def grow(rows: list[int], level: int) -> Tree | float:
        g = {i: cells[i][1] - (cells[i][1] + cells[i][2]) * prob[i] for i in rows}
        h = {i: (cells[i][1] + cells[i][2]) * prob[i] * (1 - prob[i]) for i in rows}
        worth = lambda some: sum(g[i] for i in some) ** 2 / (sum(h[i] for i in some) + ridge)
        best, found = worth(rows) + 1e-9, None
        if level < depth:
            for f in features:
                for v in range(FEATURES[f] - 1):
                    low = [i for i in rows if cells[i][0][f] <= v]
                    if 0 < len(low) < len(rows):
                        high = [i for i in rows if cells[i][0][f] > v]
                        if (w := worth(low) + worth(high)) > best:
                            best, found = w, (f, v, low, high)
        if found is None:
            return rate * sum(g.values()) / (sum(h.values()) + ridge)
        f, v, low, high = found
        return Tree(f, v, grow(low, level + 1), grow(high, level + 1))

    for _ in range(rounds if cells else 0):
        prob = [1 / (1 + exp(-max(-30.0, min(30.0, s)))) for s in score]
        tree = grow(list(range(len(cells))), 0)
        if not isinstance(tree, Tree):
            break
        trees.append(tree)
        score = [s + tree.of(c[0]) for s, c in zip(score, cells, strict=True)]
    return start, tuple(trees)


def least_score(scored: list[tuple[float, float, float]], share: float, margin: float) -> float:
    """The least score from which on ``share`` of what has it carries the label, by pooling adjacent violators over (score, with
    the label, without); ``margin`` counts without, for what was not met. Infinite if there is none."""
    pooled: list[list[float]] = []
    for s, p, n in sorted(scored):
        pooled.append([s, p, p + n])
        while len(pooled) > 1 and (pooled[-2][0] > s - 1e-9 or pooled[-2][1] * pooled[-1][2] >= pooled[-1][1] * pooled[-2][2]):
            _, p1, n1 = pooled.pop()
            pooled[-1][1:] = [pooled[-1][1] + p1, pooled[-1][2] + n1]
    return min((s - 1e-9 for s, p, n in pooled if p >= share * (n + margin)), default=float("inf"))


def fit_on(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", held: int = 5, enough: int = 20, precision: float = 0.95, agree: float = 0.5, contrast: float = 0.1, margin: float = 0.25, **options) -> SpanModel:
    """Two views of every candidate of every document, each learned from a label that its inputs do not hold; one of ``held``
    ids, by crc32, only sets the thresholds.

    No span is labelled, but some words announce one and some numbers fail their check. The view of the format learns
    which of those that pass, as only they are added, are announced, and sees no surroundings; the view of the surroundings learns which candidates pass
    their kind's check, and sees no digits and no form. Not all personal data is announced and some look-alikes are: the
    rates are those of base matches that pass and of candidates that fail. A share s of announced ones among candidates of
    one format then means that (s - fail) / (pass - fail) of them are personal data, if personal data is announced no less for being
    disguised. The format's threshold is where this reaches ``precision``; the surroundings' is where ``agree`` of the
    candidates pass. A kind whose two rates are less than ``contrast`` apart is not told by its words: nothing is added.

    Spark counts the candidates by their few binned features; only this table, whose size the bins bound, comes to the
    driver. A kind with fewer than ``enough`` held candidates is calibrated on all.
    """
    apart = (crc_mod(id_col, held) == 0).alias("held")
    each = docs.select(apart, F.explode(evidence(F.coalesce(F.col(text_col), F.lit("")))).alias("c"))
    counted = each.groupBy("held", "c.f", "c.passed").agg(F.count(F.lit(1)).alias("n")).collect()
    rows = sorted(((bool(r["held"]), r["f"].asDict(), bool(r["passed"]), float(r["n"])) for r in counted), key=lambda x: (x[0], tuple(x[1].values()), x[2]))
    few = {k for k in range(len(KINDS)) if sum(n for h, f, _, n in rows if h and f["kind"] == k) < enough}
    shown = [r[1:] for r in rows if r[0] or r[1]["kind"] in few]

    def announced(k: int, known: Callable[[dict[str, int], bool], bool]) -> tuple[float, float]:
        some = [(n, n * f["context"]) for f, passed, n in shown if f["kind"] == k and known(f, passed)]
        return sum(n for n, _ in some), sum(c for _, c in some) / max(sum(n for n, _ in some), 1.0)

    def wanted(k: int) -> float:
        (n, told), (_, chance) = announced(k, lambda f, passed: passed and f["form"] == 0), announced(k, lambda f, passed: not passed)
        return chance + precision * (told - chance) if n and told - chance >= contrast else float("inf")

    def view(features: tuple[str, ...], among: Callable[[bool], bool], label: Callable[[dict[str, int], bool], bool], shares: list[float]) -> SpanModel:
        split = lambda some: [(f, n * label(f, passed), n * (not label(f, passed))) for f, passed, n in some if among(passed)]
        model = SpanModel(*boost(split(r[1:] for r in rows if not r[0]), features, **options), (float("inf"),) * len(KINDS))
        scored = lambda k: [(model.of(f), p, n) for f, p, n in split(shown) if f["kind"] == k]
        return SpanModel(model.start, model.trees, tuple(least_score(scored(k), x, margin) if x < float("inf") else x for k, x in enumerate(shares)))

    form = view(FORMAT, bool, lambda f, passed: f["context"] == 1, [wanted(k) for k in range(len(KINDS))])
    around = view(AROUND, lambda _: True, lambda f, passed: passed, [agree] * len(KINDS))
    both = tuple(a if b < float("inf") else b for a, b in zip(form.thresholds, around.thresholds, strict=True))
    return SpanModel(form.start, form.trees, both, around)


def added_spans(text: Column, base: Column, model: SpanModel) -> Column:
    """Candidates that are plausible, reach their kind's threshold, and overlap no base span; of two that overlap the one
    with the higher score stays (ties: the earlier, then the longer). One sweep in order of start."""
    none = F.array().cast("array<struct<start:int,after:int,cost:double,stop:int,kind:int>>")

    def of(k: int, kind: str) -> Column:
        if model.thresholds[k] == float("inf"):
            return none
        scored = F.transform(found_spans(text, CANDIDATES[kind], _CANDIDATE_HINT[kind]), lambda s: let(described(k, kind, s), lambda f: F.struct(s.alias("s"), (-model.score(f, k)).alias("cost"))))
        able = F.filter(scored, lambda c: (c["cost"] <= -model.thresholds[k]) & plausible(kind, c["s"]["value"]))
        return F.transform(able, lambda c: F.struct(c["s"]["start"].alias("start"), F.lit(1).alias("after"), c["cost"].alias("cost"), c["s"]["stop"].alias("stop"), F.lit(k).alias("kind")))

    def item(start: Column, stop: Column) -> Column:
        return F.struct(start.alias("start"), F.lit(0).alias("after"), F.lit(0.0).alias("cost"), stop.alias("stop"), F.lit(-1).alias("kind"))

    end = F.lit((1 << 31) - 1)
    fixed = F.concat(F.transform(base, lambda b: item(b["start"], b["stop"])), F.array(item(end, end)))
    nothing = item(F.lit(0), F.lit(-1))

    def step(s: Column, x: Column) -> Column:
        p, clear = s["p"], F.array().cast(f"array<{SPAN}>")
        out = F.when(p["stop"] >= 0, F.array(F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["stop"].alias("stop")))).otherwise(clear)
        state = lambda until, p: F.struct(until.alias("until"), p.alias("p"))
        is_base, meets = x["after"] == 0, x["start"] < p["stop"]
        until = F.when(is_base, F.greatest(s["until"], x["stop"])).otherwise(s["until"])
        blocked = ~is_base & (x["start"] < s["until"])
        better = F.when(x["cost"] < p["cost"], x).otherwise(p)
        pending = F.when(is_base, nothing).when(blocked, p).when(meets, better).otherwise(x)
        emitted = F.when(blocked | meets, clear).otherwise(out)
        return F.struct(state(until, pending).alias("s"), emitted.alias("o"))

    first = F.struct(F.lit(0).alias("until"), nothing.alias("p"))
    sweep = lambda able: F.when(F.size(able) > 0, scan(F.array_sort(F.concat(fixed, able)), first, step, SPAN)).otherwise(F.array().cast(f"array<{SPAN}>"))
    return let(F.concat(*(of(k, kind) for k, kind in enumerate(KINDS))), sweep)


def find(docs: DataFrame, model: SpanModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (start, kind number, stop), by start and kind.

    ``spans`` holds all base spans and the ``added_spans``. Null texts are empty and have none; very long texts are
    searched whole, in time linear in their matches. Columns of ``docs`` with these names are replaced; rows are
    independent, repeated ones give equal results, and an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("base", base_spans(text))
    return out.withColumn("spans", F.array_sort(F.concat("base", added_spans(text, F.col("base"), model))))


def listed(spans: str) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; spans that overlap go as one, by the first's kind."""
    end = F.lit((1 << 31) - 1)
    span = lambda start, kind, stop: F.struct(start.alias("start"), kind.alias("kind"), stop.alias("stop"))

    def step(p: Column, x: Column) -> Column:
        meets = x["start"] < p["stop"]
        wider = span(p["start"], p["kind"], F.greatest(p["stop"], x["stop"]))
        out = F.when(meets | (p["stop"] < 0), F.array().cast(f"array<{SPAN}>")).otherwise(F.array(p))
        return F.struct(F.when(meets, wider).otherwise(x).alias("s"), out.alias("o"))

    merged = scan(F.concat(spans, F.array(span(end, F.lit(0), end))), span(F.lit(-1), F.lit(0), F.lit(-1)), step, SPAN)
    marks = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def rebuilt(cut: Column, m: Column) -> Column:
        # A place is found through stretches of fixed length, not by counting from the text's beginning.
        def part(a: Column, n: Column) -> Column:
            i = F.shiftright(a, 8)
            within = F.array_join(F.slice(cut, i + 1, F.shiftright(a + n, 8) - i + 1), "")
            return F.when(n > 0, F.substring(within, a - i * 256 + 1, n)).otherwise(F.lit(""))

        behind = lambda i: F.coalesce(F.get(m, i - 1)["stop"], F.lit(0))
        pieces = F.transform(m, lambda s, i: F.concat(part(behind(i), s["start"] - behind(i)), F.get(marks, s["kind"])))
        return F.concat(F.array_join(pieces, ""), part(behind(F.size(m)), F.length(text) - behind(F.size(m))))

    stretches = F.regexp_extract_all(text, F.lit("(?s).{1,256}"), F.lit(0))
    return F.when(F.size(spans) > 0, let(stretches, lambda cut: let(merged, lambda m: rebuilt(cut, m)))).otherwise(text)


def redact(docs: DataFrame, model: SpanModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of its text (``find``) replaced by its kind in brackets.

    Null texts stay null; empty and very long ones are handled as ``find`` does; other columns, whatever their names, are
    carried unread; repeated rows stay, and an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = let(base_spans(text), lambda base: F.array_sort(F.concat(base, added_spans(text, base, model))))
    return docs.withColumn(text_col, let(spans, lambda s: redacted(F.col(text_col), s)))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = find(docs, fit_on(docs))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
