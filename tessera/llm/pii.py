"""Personal data: candidate spans, boosted trees, calibrated thresholds. DataFrame functions only.

High-recall generators (patterns) propose overlapping spans of four kinds. The spans of the base patterns that
pass their check (parts of an address up to 255, Luhn's sum, digits of a phone number) are personal data by rule. They,
and the base spans that fail, are the labels that gradient-boosted trees learn from, over format (digits, groups, marks,
sums) and context (characters and words around). The trees then judge what the rules don't: other ways of writing,
and spans inside longer ones that failed. Log-odds are calibrated on a quarter of the labelled spans that no tree saw,
and a kind's threshold is the least calibrated probability from which ``precision`` holds there.

Every text is read once, by patterns that never look at a character more than a bounded number of times.
Labelled spans come to the driver as counts of distinct feature vectors, ``most_cells`` at most; the trees are fitted
there and go back as one column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, without

KINDS = ("email", "ip", "card", "phone")
LOCAL, HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"

#: (kind, pattern). The first of each kind is its base pattern, written so that it finds the same spans in linear
#: time: possessive, and begun only where a run of its first characters or the last match allows.
GENERATORS = (
    ("email", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[{HOST}]++(?:\.[{HOST}]++)++"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])"),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]"),
    ("email", rf"(?<![{LOCAL}])[{LOCAL}]{{1,64}}+(?: ?[\[(] ?(?:at|AT|@) ?[\])] ?| (?:at|AT) |@)[{HOST}]{{1,63}}+(?:(?: ?[\[(] ?(?:dot|DOT|\.) ?[\])] ?| (?:dot|DOT) |\.)[{HOST}]{{1,63}}+){{1,9}}+"),
    ("ip", r"(?<![0-9])[0-9]{1,3}+(?: ?[\[(]?\.[\])]? ?[0-9]{1,3}+){3}+(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"),
    ("card", r"(?<![0-9])(?:3[47][0-9]{13}|3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{16})(?![0-9])"),
    ("phone", r"(?<![0-9A-Za-z])\+?(?:[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
)
BASE = len(KINDS)
#: What a text must hold for a generator to find anything at all.
SPELLED = ("dot", "DOT", "[.]", "(.)", "[ ", "( ", ". ", " .")
NUMBERS = r"[0-9][0-9 ().\[\]-]{5,}[0-9]"
AROUND = 24  # characters of context
WORDS = {1: r"(phone|tel\b|tel\.|call|fax|mobil|cell)", 2: r"mail|contact|write to", 3: r"\bip\b|host|server|addr", 4: r"card|visa|credit|payment|account", 5: r"token|version|hash|sha|key|isbn|serial"}
FEATURES = ("kind", "source", "digits", "size", "groups", "plus", "round", "luhn", "parts", "left", "right", "about", "first")


def _found(text: str, number: int) -> Column:
    """The matches of one generator: g, k, gap (characters since the last match), found, before, after."""
    kind, pattern = GENERATORS[number]
    gaps = F.split(F.col(text), pattern, -1)
    n = F.size(gaps) - 1
    each = F.arrays_zip(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)).alias("m"), F.slice(gaps, F.lit(1), n).alias("a"), F.slice(gaps, F.lit(2), n).alias("b"))
    made = F.transform(each, lambda x, i: F.struct(F.lit(number).alias("g"), i.alias("k"), F.length(x["a"]).cast("long").alias("gap"), x["m"].alias("found"), F.right(x["a"], F.lit(AROUND)).alias("before"), F.left(x["b"], F.lit(AROUND)).alias("after")))
    numeric = F.col("_numbers")
    spelled = F.reduce(F.array(*(F.contains(F.col(text), F.lit(s)) for s in SPELLED)), F.lit(False), lambda a, b: a | b)
    may = {0: F.contains(F.col(text), F.lit("@")), 3: F.contains(F.col(text), F.lit("+")), 4: F.contains(F.col(text), F.lit("@")) | F.contains(F.col(text), F.lit("dot")) | F.contains(F.col(text), F.lit("DOT")), 5: numeric & spelled}.get(number, numeric)
    return F.when(may, made)


def luhn(digits: Column) -> Column:
    """Whether Luhn's sum of a string of digits is a multiple of ten."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c >= "5", 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def _class(c: Column) -> Column:
    """0 no character, 1 white space, 2 digit, 3 letter, 4 quote, bracket or colon, 5 comma, stop or similar, 6 all else."""
    return F.when(F.coalesce(c, F.lit("")) == "", 0).when(c.rlike(r"^\s"), 1).when(c.rlike("^[0-9]"), 2).when(c.rlike(r"^\p{L}"), 3).when(c.rlike(r"^[\"'()\[\]<>:=|]"), 4).when(c.rlike(r"^[,.;!?]"), 5).otherwise(6)


def described(rows: DataFrame) -> DataFrame:
    """Adds FEATURES, and passes: whether the rule of the span's kind accepts it (null for other generators). rows: g, found, before, after."""
    kind = F.element_at(F.array(*(F.lit(KINDS.index(k)) for k, _ in GENERATORS)), F.col("g") + 1)
    rows = rows.withColumn("kind", kind).withColumn("digits_", F.regexp_replace("found", "[^0-9]", ""))
    n = F.length("digits_")
    parts = F.split(F.regexp_replace("found", r"[^0-9.]", ""), r"\.")
    fits = F.forall(parts, lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").substr(1, 4).try_cast("int"), F.lit(0)) <= 255))
    sums = F.when((F.col("kind") == 2) & n.between(12, 19), luhn(F.col("digits_")).cast("int")).otherwise(2)
    near = F.lower("before")
    about = F.lit(0)
    for number, words in reversed(WORDS.items()):
        about = F.when(near.rlike(words), number).otherwise(about)
    rows = rows.select(
        "*", F.col("g").alias("source"), F.least(n, F.lit(25)).alias("digits"), F.least(F.length("found"), F.lit(60)).alias("size"), F.least(F.size(F.split(F.trim(F.regexp_replace("found", "[^0-9]+", " ")), " ")), F.lit(9)).alias("groups"),
        F.col("found").startswith("+").cast("int").alias("plus"), F.contains("found", F.lit("(")).cast("int").alias("round"), sums.alias("luhn"), F.when(F.col("kind") == 1, fits.cast("int")).otherwise(2).alias("parts"),
        _class(F.right("before", F.lit(1))).alias("left"), _class(F.left("after", F.lit(1))).alias("right"), about.alias("about"), F.coalesce(F.substring("digits_", 1, 1).try_cast("int"), F.lit(10)).alias("first"),
    )
    rule = F.when(F.col("kind") == 0, True).when(F.col("kind") == 1, F.col("parts") == 1).when(F.col("kind") == 2, F.col("luhn") == 1).otherwise(F.col("digits").between(8, 15))
    return rows.withColumn("passes", F.when(F.col("g") < BASE, rule)).drop("digits_")


def candidates(df: DataFrame, *, text: str, keep: list[str]) -> DataFrame:
    """A row for each proposed span, with row (a number of the document's row), the columns to keep, start, end and FEATURES; one of nulls for a document without."""
    own = {c: f"_own{i}" for i, c in enumerate(keep)}
    rows = df.select(F.monotonically_increasing_id().alias("row"), *(F.col(c).alias(n) for c, n in own.items()), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_numbers", F.col("_text").rlike(NUMBERS))
    empty = F.filter(F.array(F.struct(F.lit(0).alias("g"), F.lit(0).alias("k"), F.lit(0).cast("long").alias("gap"), *(F.lit("").alias(c) for c in ("found", "before", "after")))), lambda _: F.lit(False))
    spans = F.concat(*(F.coalesce(_found("_text", g), empty) for g in range(len(GENERATORS))))
    each = rows.select("row", *own.values(), F.explode_outer(spans).alias("c")).select("row", *own.values(), "c.*").repartition("row")
    upto = Window.partitionBy("row", "g").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("found")).over(upto)
    return described(each.withColumn("end", end).withColumn("start", F.col("end") - F.length("found"))).drop("k", "gap", "before", "after")


@dataclass
class SpanModel:
    bias: float
    trees: list[tuple]  # (feature, edge, tree if at most edge, tree if above), or a float
    scale: tuple[float, float]  # calibrated log-odds = a * raw + b
    thresholds: list[float]  # by kind


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, *, ridge: float = 1.0, least: float = 1.0, rate: float = 0.3) -> tuple | float:
    """A regression tree on gradients g and curvatures h by exact splits of small integers."""
    best, score = None, 1e-6
    whole = g.sum() ** 2 / (h.sum() + ridge)
    for f in range(x.shape[1]) if depth else ():
        low = x[:, f].min()
        gs, hs = (np.cumsum(np.bincount(x[:, f] - low, v)) for v in (g, h))
        left, right = hs[:-1], hs[-1] - hs[:-1]
        gain = gs[:-1] ** 2 / (left + ridge) + (gs[-1] - gs[:-1]) ** 2 / (right + ridge) - whole
        gain[(left < least) | (right < least)] = 0
        if len(gain) and gain.max() > score:
            best, score = (f, int(low + gain.argmax())), gain.max()
    if best is None:
        return float(-rate * g.sum() / (h.sum() + ridge))
    f, edge = best
    side = x[:, f] <= edge
    return (f, edge, grow(x[side], g[side], h[side], depth - 1, ridge=ridge, least=least, rate=rate), grow(x[~side], g[~side], h[~side], depth - 1, ridge=ridge, least=least, rate=rate))


def raw(model: SpanModel, x: np.ndarray) -> np.ndarray:
    def walk(tree, rows: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(rows), tree)
        f, edge, low, high = tree
        side = rows[:, f] <= edge
        out = np.empty(len(rows))
        out[side], out[~side] = walk(low, rows[side]), walk(high, rows[~side])
        return out

    return model.bias + sum((walk(t, x) for t in model.trees), np.zeros(len(x)))


def fit(x: np.ndarray, good: np.ndarray, all_: np.ndarray, held: np.ndarray, *, rounds: int = 30, depth: int = 3, precision: float = 0.95) -> SpanModel | None:
    """x: distinct feature vectors; good of all_ spans of each are accepted; held: the vectors to calibrate on. None without spans of both labels on both sides."""
    for side in (held, ~held):
        if not good[side].sum() or good[side].sum() == all_[side].sum():
            return None
    xs, n1, n = x[~held], good[~held].astype(float), all_[~held].astype(float)
    model = SpanModel(float(np.log(n1.sum() / (n.sum() - n1.sum()))), [], (1.0, 0.0), [])
    z = np.full(len(xs), model.bias)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        tree = grow(xs, n * p - n1, n * p * (1 - p), depth)
        model.trees.append(tree)
        z += raw(SpanModel(0.0, [tree], (1.0, 0.0), []), xs)
    z, n1, n = raw(model, x[held]), good[held].astype(float), all_[held].astype(float)
    a, b = 1.0, 0.0
    high, low = (n1.sum() + 1) / (n1.sum() + 2), 1 / (n.sum() - n1.sum() + 2)  # Platt's targets
    t = n1 * high + (n - n1) * low
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        d, c = n * p - t, np.maximum(n * p * (1 - p), 1e-9)
        step = np.linalg.solve([[(c * z * z).sum() + 1e-3, (c * z).sum()], [(c * z).sum(), c.sum() + 1e-6]], [(d * z).sum() + 1e-3 * (a - 1), d.sum()])
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    model.scale = (float(a), float(b))
    p, kinds = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))), x[held][:, FEATURES.index("kind")]
    for kind in range(len(KINDS)):
        own = np.flatnonzero(kinds == kind)
        own = own[np.argsort(-p[own], kind="stable")]
        right, of = np.cumsum(n1[own]), np.cumsum(n[own])
        last = np.append(np.diff(p[own]) != 0, True)[: len(own)]  # vectors of one probability stand or fall together
        fine = np.flatnonzero(last & (right >= precision * of) & (right > 0))
        model.thresholds.append(max(0.5, float(p[own][fine[-1]])) if len(fine) else 2.0)
    return model


def train_spans(rows: DataFrame, *, most_cells: int = 20_000, **settings) -> SpanModel | None:
    """Fit on the base patterns' spans as counts of distinct feature vectors, at most ``most_cells`` of them, chosen by their hash."""
    known = rows.where(F.col("passes").isNotNull()).withColumn("held", F.pmod(F.xxhash64("found"), F.lit(4)) == 3)
    cells = known.groupBy("held", *FEATURES).agg(F.sum(F.col("passes").cast("long")).alias("good"), F.count(F.lit(1)).alias("all")).orderBy(F.xxhash64("held", *FEATURES), "held", *FEATURES).limit(most_cells).collect()
    if not cells:
        return None
    x = np.array([[c[f] for f in FEATURES] for c in cells], np.int64)
    good, every, held = (np.array([c[k] for c in cells]) for k in ("good", "all", "held"))
    return fit(x, good, every, held.astype(bool), **settings)


def probability(model: SpanModel) -> Column:
    """The calibrated probability of a row with FEATURES."""

    def column(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(tree)
        f, edge, low, high = tree
        return F.when(F.col(FEATURES[f]) <= edge, column(low)).otherwise(column(high))

    z = F.lit(model.bias)
    for tree in model.trees:
        z = z + column(tree)
    a, b = model.scale
    return 1 / (1 + F.exp(-F.greatest(F.least(a * z + b, F.lit(40.0)), F.lit(-40.0))))


def selected(rows: DataFrame, model: SpanModel | None) -> DataFrame:
    """Candidates with score and base; those that are neither base nor chosen have a null kind, so no document is lost.

    Chosen are spans from their kind's threshold on that overlap no accepted base span; of those that overlap one
    another (by chains), the one with the highest score, then the longest, then the first.
    """
    base = F.coalesce(F.col("passes"), F.lit(False))
    rows = rows.withColumn("base", base)
    if model is None:
        return rows.select("*", F.when(base, 1.0).alias("score")).withColumn("kind", F.when(base, F.col("kind")))
    least = F.element_at(F.array(*(F.lit(float(t)) for t in model.thresholds)), F.col("kind") + 1)
    rows = rows.withColumn("score", F.when(base, 1.0).otherwise(probability(model)))
    rows = rows.withColumn("chosen", ~base & F.col("kind").isNotNull() & (F.col("score") >= least))
    in_text = Window.partitionBy("row").orderBy("start")
    before = F.max(F.when(base, F.col("end"))).over(in_text.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(F.when(base, F.col("start"))).over(in_text.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("chosen", F.col("chosen") & ~F.coalesce(before > F.col("start"), F.lit(False)) & ~F.coalesce(after < F.col("end"), F.lit(False)))
    ordered = Window.partitionBy("row").orderBy("start", "end", "g")
    reach = F.max(F.when(F.col("chosen"), F.col("end"))).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("island", F.sum((F.col("chosen") & F.coalesce(F.col("start") >= reach, F.lit(True))).cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    best = Window.partitionBy("row", "island").orderBy(F.col("chosen").desc(), F.col("score").desc(), (F.col("end") - F.col("start")).desc(), "start", "g")
    taken = F.col("base") | (F.col("chosen") & (F.row_number().over(best) == 1))
    return rows.withColumn("kind", F.when(taken, F.col("kind"))).drop("chosen", "island")


def pii_spans(df: DataFrame, *, text: str = "text", keep: list[str] | None = None, **settings) -> DataFrame:
    """A row for each row of ``df``: the columns named in ``keep`` (all but the text unless given) and pii_spans.

    pii_spans: array of (kind, start, end, score, base) by kind and start, code points, end exclusive. Null and
    empty texts have none. Repeated rows are judged one by one, alike; a very long text is one row's work in a task.
    Without base spans of both labels no model is fitted and only the base spans are given.
    """
    keep = [c for c in df.columns if c not in (text, "pii_spans")] if keep is None else keep
    rows = materialize(candidates(df, text=text, keep=keep), "spans")
    found = selected(rows, train_spans(rows, **settings))
    span = F.when(F.col("kind").isNotNull(), F.struct("kind", "start", "end", "score", "base"))
    lists = found.groupBy("row").agg(*(F.first(f"_own{i}").alias(f"_own{i}") for i in range(len(keep))), F.array_sort(F.collect_list(span)).alias("_spans"))
    named = F.transform("_spans", lambda s: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"), s["base"].alias("base")))
    return lists.select(*(F.col(f"_own{i}").alias(c) for i, c in enumerate(keep)), named.alias("pii_spans"))


def listed_spans(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(df: DataFrame, *, text: str = "text", **settings) -> DataFrame:
    """Every row of ``df`` with pii_spans and redacted: its text with ``[KIND]`` in place of each span; a null text stays null.

    Spans that overlap become one mark, that of the first. Columns of these two names are replaced.
    """
    df = without(df, "pii_spans", "redacted")
    (row,) = fresh(df, "_row")
    rows = materialize(df.withColumn(row, F.monotonically_increasing_id()), "pii-rows")
    found = materialize(pii_spans(rows, text=text, keep=[row], **settings), "pii-spans")
    ordered = F.array_sort(F.transform("pii_spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("last"), s["end"].alias("end"), s["kind"].alias("kind"))))
    # The end of all spans before each: spans of a text are few, as each takes several of its characters.
    upto = F.transform(ordered, lambda s, i: F.coalesce(F.array_max(F.transform(F.slice(ordered, F.lit(1), i), lambda e: e["end"])), F.lit(0).cast("long")))
    found = found.select(row, "pii_spans", ordered.alias("_ordered"), upto.alias("_upto"))
    cut = F.transform(F.arrays_zip("_ordered", "_upto"), lambda x: F.when(x["_ordered"]["start"] >= x["_upto"], F.concat(F.substring(F.col(text), (x["_upto"] + 1).cast("int"), (x["_ordered"]["start"] - x["_upto"]).cast("int")), F.lit("["), F.upper(x["_ordered"]["kind"]), F.lit("]"))).otherwise(""))
    last = F.coalesce(F.array_max(F.transform("_ordered", lambda s: s["end"])), F.lit(0).cast("long"))
    joined = rows.join(found, row).withColumn("redacted", F.when(F.col(text).isNotNull(), F.concat(F.array_join(cut, ""), F.substring(F.col(text), (last + 1).cast("int"), F.length(text)))))
    return joined.select(*df.columns, "pii_spans", "redacted")
